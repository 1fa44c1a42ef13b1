"""Operator 7: secret scans by patterns and a linear-chain conditional random field.

Three patterns give the base spans. The CRF tags tokens as begin, inside or outside of a secret from
their shape, the words around them and features of the whole text, and is decoded by Viterbi; its
spans are added where no base span covers them. It is trained on texts made here from a seed, the
same in every run and cut into tokens like any other: secrets in many spellings, and things that look
like them but are none (mail and network addresses, phone numbers, dates, versions, prices, links,
words in mixed case).

Every token has features and every position of a text is scored. Texts are decoded exactly as if whole:
a token is outside for certain where that beats any other tag whatever stands around it, by a bound on
all moves between tags (`Crf.certain`); such tokens part a text, and Viterbi decodes what lies between
them (a test says that the result is that of whole texts). What depends on a token alone is kept by
token, up to KEEP of them.

Whole texts of any length are scanned; offsets are code points, ends exclusive. Null texts are empty
and have no spans; repeated rows are scanned like any other; spans that start together go by kind; an
empty table gives an empty table; a column spans of the input is replaced by secret_spans(), and
secret_report() reads doc_id and text alone.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
#: Characters of a long token, and tokens before a token that its features look at.
LONG, BACK = 10, 5
#: Tokens that are scored at once; tokens and characters of tokens that a process keeps scores of.
BLOCK, KEEP, KEEP_CHARS = 1 << 15, 1 << 18, 4 << 20

_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?|[^\sA-Za-z0-9+/_-]")
_CUES = frozenset("password passwd passphrase pwd pass secret token key apikey api_key access_key private credential credentials auth authorization bearer login signature".split())
_CHANGE = re.compile(r"[a-z][A-Z]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|([+/_=-])\1*")
_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xox", "eyJ", "AIza", "glpat-", "SG")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _turns(token: str, most: int = 12) -> int:
    """Runs of one kind of character, up to `most`."""
    return sum(1 for _ in islice(_RUN.finditer(token), most)) if token.isascii() else 1


def _entropy(token: str) -> float:
    n, kinds = len(token), set(token)
    if len(kinds) == n:
        return math.log2(n)
    return -sum(c / n * math.log2(c / n) for c in (token.count(x) for x in kinds))


def own_features(t: str) -> tuple[list[str], str]:
    """(names of the features that a token alone decides, the kinds of its characters)."""
    digits, n = sum(map(str.isdigit, t)), len(t)
    upper, lower = any(map(str.isupper, t)), any(map(str.islower, t))
    mixed = ("d" if digits else "") + ("U" if upper else "") + ("l" if lower else "")
    words = [len(x) for x in re.findall("[a-z]+", t)]
    f = ["bias", f"len:{min(n, 40) // 4}", f"mix:{mixed}", f"part:{4 * digits // n}", f"change:{bool(_CHANGE.search(t))} {n >= LONG}"]
    f += [f"turns:{_turns(t) // 2}", f"bits:{int(_entropy(t) * 2)}", f"head:{t.startswith(_HEADS)}", f"slashes:{min(t.count('/'), 3)}", f"dashes:{min(t.count('-'), 5)}", f"low runs:{min(int(2 * sum(words) / max(len(words), 1)), 12)}"]
    return f, mixed


def _cue_features(mixed: str, n: int, near: bool) -> list[str]:
    return [f"cue near:{near}", f"mix and cue:{mixed} {near} {min(n, 24) // 6}"]


def _sign(low: str, cues: bool) -> str:
    """What a neighbour shows of itself."""
    return low if len(low) == 1 or (cues and low in _CUES) else "word"


def token_features(tokens: list[str], of_text: list[str]) -> list[list[str]]:
    """Names of each token's features: shape, neighbouring words and of_text, those of its text."""
    low = [t.lower() for t in tokens]
    out = []
    for i, t in enumerate(tokens):
        f, mixed = own_features(t)
        f += _cue_features(mixed, len(t), any(x in _CUES for x in low[max(0, i - BACK) : i]))
        f += [f"{'long' if len(t) >= LONG else 'short'}+{x}" for x in of_text]
        f += [f"before{d}:{_sign(low[i - d], True) if i >= d else 'start'}" for d in (1, 2, 3)]
        f += [f"after:{_sign(low[i + 1], False) if i + 1 < len(tokens) else 'end'}"]
        out.append(f)
    return out


def text_features(text: str) -> list[str]:
    """Features of a whole text: how much of it is symbols and digits, and its cue words."""
    n = max(len(text), 1)
    code = sum(text.count(c) for c in "={}();")
    return [f"code:{min(int(200 * code / n), 3)}", f"has cue:{any(x in text for x in ('password', 'secret', 'token', 'key'))}"]


class Crf:
    """Weights by feature name and tag, and between neighbouring tags."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves
        self._forget()

    def __reduce__(self):
        return Crf, (self.names, self.weights, self.moves)

    def sum_of(self, features: list[str]) -> np.ndarray:
        return self.weights[[self.names[x] for x in features if x in self.names]].sum(axis=0)

    def scores(self, features: list[list[str]]) -> np.ndarray:
        """By token and tag."""
        return np.array([self.sum_of(f) for f in features])

    def _forget(self) -> None:
        """Rows 0 and 1 stand for what is before and behind a text."""
        self.rows: dict[str, int] = {}
        self.shapes: dict[tuple, int] = {}
        self.chars = 0
        self.alone, self.before, self.after = np.zeros((1024, 2, 3)), np.zeros((1024, 3, 3)), np.zeros((1024, 3))
        self.is_long, self.is_cue = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.before[0], self.after[1] = [self.sum_of([f"before{d}:start"]) for d in (1, 2, 3)], self.sum_of(["after:end"])

    def _row(self, t: str) -> int:
        """Tokens with the same features share a row."""
        row = self.rows.get(t)
        if row is not None:
            return row
        self.chars += len(t)
        low, n = t.lower(), len(t)
        sign = _sign(low, True)
        if t.islower() and t.isascii() and t.isalpha():  # all that own_features() tells of plain words
            shape = (n, int(_entropy(t) * 2), t.startswith(_HEADS), sign)
        else:
            f, mixed = own_features(t)
            shape = (*f, mixed, n >= LONG, min(n, 24) // 6, sign)
        row = self.shapes.get(shape)
        if row is None:
            row = self.shapes[shape] = len(self.shapes) + 2
            if row == len(self.alone):
                for name in ("alone", "before", "after", "is_long", "is_cue"):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
            f, mixed = own_features(t)
            self.alone[row] = [self.sum_of(f + _cue_features(mixed, n, near)) for near in (False, True)]
            self.before[row] = [self.sum_of([f"before{d}:{sign}"]) for d in (1, 2, 3)]
            self.after[row] = self.sum_of([f"after:{_sign(low, False)}"])
            self.is_long[row], self.is_cue[row] = n >= LONG, low in _CUES
        self.rows[t] = row
        return row

    def scores_of(self, tokens: list[str], of_text: np.ndarray) -> np.ndarray:
        """What scores() gives for token_features(); of_text: the sums of a text's features for short and long tokens."""
        if len(self.rows) > KEEP or self.chars > KEEP_CHARS:
            self._forget()
        found = list(map(self.rows.get, tokens))
        if None in found:
            found = [self._row(t) if r is None else r for t, r in zip(tokens, found, strict=True)]
        r = np.array([0, 0, 0, *found, 1])
        own = r[3:-1]
        cues = np.concatenate([np.zeros(BACK + 1, np.int64), np.cumsum(self.is_cue[own])])
        near = (cues[BACK:-1] > cues[: -BACK - 1]).astype(np.int64)
        return self.alone[own, near] + of_text[self.is_long[own]] + self.before[r[2:-2], 0] + self.before[r[1:-3], 1] + self.before[r[:-4], 2] + self.after[r[4:]]

    def certain(self, score: np.ndarray) -> np.ndarray:
        """Tokens that are outside on the best path whatever the tags around them are.

        Another tag of the token is made outside, and an inside one after it begin: if that gains for
        all tags before and behind, the path was not the best.
        """
        m, out = self.moves, np.ones(len(score), bool)
        then = np.concatenate([score[1:, BEGIN] - score[1:, INSIDE], np.zeros(1)])
        for t in (BEGIN, INSIDE):
            before = min([0.0, *(m[p, OUTSIDE] - m[p, t] for p in range(3) if m[p, t] > -1e8)])
            behind = min(0.0, *(m[OUTSIDE, x] - m[t, x] for x in (OUTSIDE, BEGIN)))
            inside = m[OUTSIDE, BEGIN] - m[t, INSIDE] + min(0.0, *(m[BEGIN, y] - m[INSIDE, y] for y in range(3)))
            out &= score[:, OUTSIDE] - score[:, t] + before + np.minimum(behind, inside + then) > 1e-6
        return out

    def between(self, score: np.ndarray, starts: bool, ends: bool) -> list[int]:
        """The most likely tags of tokens between outside ones, or the edges of the text."""
        score = score.copy()
        if not starts:
            score[0] += self.moves[OUTSIDE]
        if not ends:
            score[-1] += self.moves[:, OUTSIDE]
        return self._path(score)

    def decode(self, features: list[list[str]]) -> list[int]:
        """The most likely tags: Viterbi."""
        return self._path(self.scores(features))

    def _path(self, score: np.ndarray) -> list[int]:
        best, back = score[0].copy(), []
        best[INSIDE] = -1e9
        for s in score[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + s
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """One training text and the stretches of it that are secrets."""
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6)))
    camel = lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 3)))
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    lo, up, dg = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    lead = lambda: rng.choice(["password: ", "password ", "passphrase: ", "secret = ", "token=", "api_key: ", "Authorization: Bearer ", "access key ", "the private key is ", "private key: ", "login with password ", "auth token ", "signature=", "credentials: ", "pwd="])
    parts: list[tuple[str, bool]] = [(" ".join(word() for _ in range(rng.randint(1, 7))) + " ", False)]
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.5:
            value = rng.choice([
                lambda: some(lo + up + dg, 16, 44), lambda: some(lo + up + dg + "+/", 24, 44) + "=" * rng.randint(0, 2), lambda: some("abcdef" + dg, 16, 64),
                lambda: "ghp_" + some(lo + up + dg, 30, 36), lambda: "sk-" + some(lo + up + dg, 20, 48), lambda: "sk_live_" + some(lo + up + dg, 20, 28), lambda: "AKIA" + some(up + dg, 16, 16),
                lambda: "eyJ" + some(lo + up + dg + "_-", 30, 60), lambda: "xoxb-" + some(dg, 10, 12) + "-" + some(lo + up + dg, 20, 24), lambda: some(lo + up + dg, 10, 14),
                lambda: some(lo + up, 10, 44), lambda: some(lo + dg, 6, 9), lambda: some(lo + up + dg, 6, 9), lambda: some(dg, 8, 16), lambda: word() + some(dg, 2, 4), lambda: some(lo + up, 6, 10),
            ])()
            if not _DIGIT.search(value) and not _CHANGE.search(value):
                value += some(dg, 2, 2)
            if value.isdigit() or len(value) < 16 or rng.random() < 0.7:
                parts.append((lead(), False))
            else:
                parts.append((rng.choice(["", "use ", "see "]), False))
            parts += [(value, True), (rng.choice(["", ".", ",", ";", '"']), False)]
        else:
            parts.append((rng.choice([
                lambda: f"{word()}.{some(dg, 1, 3)}@mail{some(dg, 1, 1)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"+{some(dg, 1, 2)}-{some(dg, 3, 3)}-{some(dg, 3, 4)}-{some(dg, 4, 4)}",
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: some(dg, 10, 19), lambda: f"{some(dg, 4, 4)}-{some(dg, 4, 4)}-{some(dg, 4, 4)}-{some(dg, 4, 4)}", lambda: f"https://{word()}.example.org/{word()}/{some(dg, 1, 6)}/{word()}",
                lambda: f"v{some(dg, 1, 1)}.{some(dg, 1, 2)}.{some(dg, 1, 2)}", lambda: f"{word()}-{some(dg, 1, 4)}-{word()}-{word()}", lambda: f"{word()}{word()}{some(dg, 1, 4)}", lambda: f"${some(dg, 1, 5)}.{some(dg, 2, 2)}",
                lambda: "the password " + word(), lambda: "a secret: " + word(), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:00:00", lambda: f"{word()}_{some(dg, 1, 3)}_{word()}_{word()}", lambda: word() + some("*#$%&", 3, 3),
                camel, camel, lambda: word() + camel(), lambda: "the key " + camel(), lambda: f"login on {rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"a token of {word()} and {camel()}", lambda: f"pass {some(dg, 1, 4)} {word()}",
                lambda: f"the secret of {word()} {word()} {word()}{some(dg, 1, 2)}", lambda: f"{word()}_{word()}{camel()}", lambda: f"login from {'.'.join(str(rng.randint(0, 255)) for _ in range(4))}",
            ])(), False))
        parts.append((" " + " ".join(word() for _ in range(rng.randint(1, 6))) + " ", False))
    text, spans = "", []
    for part, is_secret in parts:
        if is_secret:
            spans.append((len(text), len(text) + len(part)))
        text += part
    return text, spans


def tagged(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Tokens and tags of a text with known secrets."""
    found = list(_TOKEN.finditer(text))
    tags, before = [], None
    for m in found:
        own = next((s for s in spans if s[0] <= m.start() < s[1]), None)
        tags.append(OUTSIDE if own is None else INSIDE if own == before else BEGIN)
        before = own
    return [m[0] for m in found], tags


@lru_cache(1)
def trained(sequences: int = 1600, rounds: int = 60, seed: int = 7, rate: float = 0.15, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by gradient ascent (Adam) over forward-backward marginals of made texts; kept by the process."""
    rng = random.Random(seed)
    texts = [_made(rng) for _ in range(sequences)]
    data = [tagged(*x) for x in texts]
    feats = [token_features(t, text_features(x)) for (t, _), (x, _) in zip(data, texts, strict=True)]
    names: dict[str, int] = {}
    for f in feats:
        for x in f:
            for y in x:
                names.setdefault(y, len(names))
    longest = max(len(t) for t, _ in data)
    there = np.array([[j < len(t) for j in range(longest)] for t, _ in data])
    # Features of one token after the other, for the tokens that have any.
    own = [(i, j, x) for i, f in enumerate(feats) for j, x in enumerate(f) if x]
    seq, at = np.array([i for i, _, _ in own]), np.array([j for _, j, _ in own])
    feature = np.array([names[y] for _, _, x in own for y in x])
    count = np.array([len(x) for _, _, x in own])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(feature, kind="stable")
    starts = np.searchsorted(feature[order], np.arange(len(names)))
    token = np.repeat(np.arange(len(own)), count)[order]
    gold = np.zeros((sequences, longest, 3))
    for i, (_, tags) in enumerate(data):
        gold[i, np.arange(len(tags)), tags] = 1
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    w, m = np.zeros((len(names), 3)), np.zeros((3, 3))
    first_m, second_m = [np.zeros_like(w), np.zeros_like(m)], [np.zeros_like(w), np.zeros_like(m)]
    for step in range(1, rounds + 1):
        score = np.zeros((sequences, longest, 3))
        score[:, :, 1:] = -1e9
        score[seq, at] = np.add.reduceat(w[feature], first)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for j in range(1, longest):
            ways = np.logaddexp.reduce(ahead[:, j - 1, :, None] + m, axis=1) + score[:, j]
            ahead[:, j] = np.where(there[:, j, None], ways, ahead[:, j - 1])
        for j in range(longest - 2, -1, -1):
            ways = np.logaddexp.reduce(m + (score[:, j + 1] + behind[:, j + 1])[:, None, :], axis=2)
            behind[:, j] = np.where(there[:, j + 1, None], ways, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        each = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
        two = np.exp(ahead[:, :-1, :, None] + m + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
        gw = np.add.reduceat((gold - each)[seq, at][token], starts)
        grads = (gw / sequences - decay * w, (gold_moves - two.sum(axis=(0, 1))) / sequences - decay * m)
        for p, g, a, b in zip((w, m), grads, first_m, second_m, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    m = m.copy()
    m[OUTSIDE, INSIDE] = -1e9
    return Crf(names, w, m)


def crf_spans(model: Crf, text: str) -> list[tuple[int, int]]:
    """Spans of all tokens that the model tags; a block of tokens at a time, up to one that is outside for certain."""
    names = text_features(text)
    of_text = np.array([model.sum_of([f"{x}+{y}" for y in names]) for x in ("short", "long")])
    matches, found = _TOKEN.finditer(text), []
    held: list[re.Match] = []
    first, done, more = True, 0, True
    while more:
        new = list(islice(matches, BLOCK))
        more = len(new) == BLOCK
        held += new
        if not held:
            break
        score = model.scores_of([m[0] for m in held], of_text)
        sure, n = model.certain(score), len(held)
        if more:  # what follows the last two tokens is not known
            last = np.flatnonzero(sure[done : n - 2])
            if not len(last):
                continue
            n = done + int(last[-1]) + 1
        open_ = np.flatnonzero(~sure[done:n]) + done
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else ():
            a, b = int(run[0]), int(run[-1]) + 1
            for i, tag in enumerate(model.between(score[a:b], first and a == 0, not more and b == n), a):
                if tag == BEGIN:
                    found.append((held[i].start(), held[i].end()))
                elif tag == INSIDE:
                    found[-1] = (found[-1][0], held[i].end())
        keep = max(n - BACK, 0)
        first, done, held = first and keep == 0, n - keep, held[keep:]
    return found


def all_spans(model: Crf, text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    more = [(a, 3, b) for a, b in crf_spans(model, text) if not any(s <= a and b <= e for s, _, e in base)]
    return sorted(base + more)


def secret_spans(df: DataFrame, text: str = "text", model: Crf | None = None) -> DataFrame:
    """df with `spans`: array of (kind, start, end)."""
    shared = df.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def of(col):
        import pandas as pd

        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(shared.value, t)] for t in col.fillna("")], index=col.index)

    return df.withColumn("spans", of(F.col(text)))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def secret_report(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """Counts, digest and spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                spans = all_spans(shared.value, text or "")
                base = [s for s in spans if s[1] < 3]
                n = [sum(k == j for _, k, _ in spans) for j in range(4)]
                out.append((doc_id, *n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
            if out:
                kinds = (pa.int64(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _REPORT.split(", ")])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, _REPORT)
