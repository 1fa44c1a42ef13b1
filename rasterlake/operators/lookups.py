"""Lookups: positions in runs, the next run, stored blobs, the nearest place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formats import haversine

SLACK_KM, NOTABLE = 8.0, 4


def point_in_run(points: DataFrame, runs: DataFrame, key: str, pos: str, bucket: int) -> DataFrame:
    """points with the run of their object that holds them (inner).

    A run is listed under each block of `bucket` positions that it touches, so that the join is on
    (key, block) and not a nested loop; a block of one object holds at most `bucket` disjoint runs.
    """
    r = runs.withColumn("__block", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.greatest(F.col("len") - 1, F.lit(0))) / bucket))))
    p = points.withColumn("__block", F.floor(F.col(pos) / bucket))
    return p.join(r, [key, "__block"]).where((F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("start") + F.col("len"))).drop("__block")


def next_run(points: DataFrame, runs: DataFrame, key: str, pos: str) -> DataFrame:
    """points with next_start: the start of the first run after them, null for none.

    Points and runs of an object are sorted together once; each point looks ahead.
    """
    both = points.select(key, F.col(pos).alias("__at"), F.lit(None).cast("long").alias("__start"), F.struct(*points.columns).alias("__p")).unionByName(runs.select(key, F.col("start").alias("__at"), F.col("start").cast("long").alias("__start"), F.lit(None).cast(points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType).alias("__p")))
    ahead = Window.partitionBy(key).orderBy("__at").rangeBetween(1, Window.unboundedFollowing)
    both = both.withColumn("next_start", F.min("__start").over(ahead))
    return both.where("__p is not null").select("__p.*", "next_start")


def stored_segments(segments: DataFrame, blobs: DataFrame, on: list[str], strict: bool) -> DataFrame:
    """segments with stored: their blob's bytes; without a blob 0, or status missing where strict."""
    out = segments.join(blobs.select(*on, F.col("stored").alias("__stored")), on, "left")
    out = out.withColumn("status", F.when(F.col("__stored").isNull() & F.lit(strict), F.lit("missing")).otherwise(F.lit("ok")))
    return out.withColumn("stored", F.coalesce("__stored", F.lit(0))).drop("__stored")


def _cells(reach: Column) -> tuple[Column, Column]:
    """(band of latitude, how many cells its band has) for columns __lat and __band, cells being `reach` km in size.

    Bands are as high as reach. A cell of a band is as wide as reach is at the highest latitude
    that a place within reach can have, so that places within reach lie in neighbouring cells.
    """
    high = reach / 111.0
    top = F.least(F.greatest(F.abs(F.col("__band") - 1), F.abs(F.col("__band") + 2)) * high, F.lit(90.0))
    share = F.sin(F.least(reach / 6371.0088, F.lit(math.pi / 2)))
    wide = F.cos(F.radians(top))
    width = F.when(wide > share * 1.001, F.degrees(F.asin(F.least(share / F.greatest(wide, F.lit(1e-9)), F.lit(1.0)))) * 1.001).otherwise(F.lit(360.0))
    return F.floor(F.col("__lat") / high), F.greatest(F.floor(360.0 / width), F.lit(1)).cast("int")


def nearest_place(points: DataFrame, places: DataFrame, key: str, max_km: float) -> DataFrame:
    """(key, city, country, km): the nearest place within max_km, or a much larger one hardly further.

    points: key, lat, lon; invalid ones have no row. places: city, country, lat, lon, population.
    Places stand in cells of several sizes, max_km and its halves down to less than SLACK_KM, and in
    those around them; places with the same coordinates are one. A point asks the cells it is in for a
    place each: the nearest of these bounds how far the nearest place of all can be, so that the point
    meets only the places around it in cells of that size, and in a second join those in cells of the
    size of the least distance and SLACK_KM. Points with the same coordinates do so once. Joins are by
    cell and none is a broadcast, as each place stands in 9 cells of every size. Of all places within
    SLACK_KM of the least distance the largest is notable if any is.
    """
    sizes = max(int(math.log2(max_km / SLACK_KM)) + 2, 1) if max_km > SLACK_KM else 1
    band, n = _cells(F.lit(max_km) / F.pow(F.lit(2.0), F.col("__size")))
    ok = F.col("lat").between(-90, 90) & ~F.isnan("lat") & ~F.isnan("lon") & (F.abs("lon") < float("inf"))
    at = lambda lon: F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / (360.0 / F.col("__n"))).cast("int"), F.col("__n"))
    every = F.explode(F.array(*(F.lit(i) for i in range(sizes))))
    around = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    cell = ["__size", "__band", "__cell"]

    def placed(p: DataFrame) -> DataFrame:
        return p.withColumn("__band", band).withColumn("__n", n).withColumn("__cell", at(F.col("__lon"))).drop("__n")

    def size_for(km: Column) -> Column:
        """The smallest cells that reach so far."""
        return sum((F.when(km <= max_km / 2.0**i, 1).otherwise(0) for i in range(1, sizes)), F.lit(0))

    p = points.where(ok).select(key, F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    name, people = F.struct("city", "country"), F.struct("population", "city", "country")
    c = places.where(ok).groupBy("lat", "lon").agg(F.min(F.struct("city", "country", "population")).alias("least"), F.max(name).alias("last"), F.max(people).alias("large"))
    c = c.withColumn("__lat", F.col("lat")).withColumn("__size", every).withColumn("__up", around)
    c = c.withColumn("__band", band + F.col("__up")).withColumn("__n", n).withColumn("__side", around)
    # In a band of one or two cells the neighbours on both sides are the same cell.
    c = c.where((F.col("__n") > 2) | (F.col("__side") == 0) | ((F.col("__n") == 2) & (F.col("__side") == 1)))
    c = c.withColumn("__cell", F.pmod(at(F.col("lon")) + F.col("__side"), F.col("__n"))).drop("__lat", "__n")
    km = haversine(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))

    some = c.groupBy(*cell).agg(F.min(F.struct((F.abs("__up") + F.abs("__side")).alias("off"), "lat", "lon")).alias("__some")).select(*cell, "__some.lat", "__some.lon")
    spot = ["__lat", "__lon"]
    asked = placed(p.select(*spot).distinct().withColumn("__size", every)).join(some.hint("merge"), cell).groupBy(*spot).agg(F.min(km).alias("__bound"))
    near = placed(asked.withColumn("__size", size_for(F.col("__bound")))).join(c.select(*cell, "lat", "lon").hint("merge"), cell)
    least = near.select(*spot, km.alias("km")).where(F.col("km") <= max_km).groupBy(*spot).agg(F.min("km").alias("__km"))
    own = p.join(least, spot)
    own = own.drop("__km").join(own.groupBy(key).agg(F.min("__km").alias("__km")), key).distinct()
    spot = [*spot, "__km"]
    near = placed(own.select(*spot).distinct().withColumn("__size", size_for(F.col("__km") + SLACK_KM))).join(c.select(*cell, "lat", "lon", "least", "last", "large").hint("merge"), cell)
    near = near.withColumn("km", km).where((F.col("km") <= max_km) & (F.col("km") <= F.col("__km") + SLACK_KM))

    first, last, large = F.struct("km", "least"), F.struct((-F.col("km")).alias("km"), "last"), F.struct("large.population", (-F.col("km")).alias("km"), "large.city", "large.country")
    of_spot = near.groupBy(*spot).agg(F.min(first).alias("first"), F.max(last).alias("last"), F.max(large).alias("large"))
    out = own.join(of_spot, spot).groupBy(key).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("large").alias("large"))
    place = lambda name, x: F.struct(F.col(f"{name}.city"), F.col(f"{name}.country"), (-F.col(f"{x}.km")).alias("km"))
    notable = F.col("large.population") >= NOTABLE * F.col("first.least.population")
    return out.select(key, F.when(notable, place("large", "large")).otherwise(place("last.last", "last")).alias("b")).select(key, "b.city", "b.country", "b.km")
