"""Fixed dictionaries of image metadata: tag names by directory, texts of enumerated values, ratios.

Fixed values: the numbers and names below are the formats'; the texts of enumerated values are wording
that must match what readers are shown.
"""

from __future__ import annotations

#: number, name and kind (plain where none is given) of the interoperability directory's tags.
INTEROP = """
1 InteroperabilityIndex
2 InteroperabilityVersion
4096 RelatedImageFileFormat
4097 RelatedImageWidth
4098 RelatedImageLength
"""

#: The same of the GPS directory.
GPS = """
0 GPSVersionID
1 GPSLatitudeRef Sensitive
2 GPSLatitude Sensitive
3 GPSLongitudeRef Sensitive
4 GPSLongitude Sensitive
5 GPSAltitudeRef Sensitive
6 GPSAltitude Sensitive
7 GPSTimeStamp
8 GPSSatellites
9 GPSStatus
10 GPSMeasureMode
11 GPSDOP
12 GPSSpeedRef
13 GPSSpeed
14 GPSTrackRef
15 GPSTrack
16 GPSImgDirectionRef
17 GPSImgDirection
18 GPSMapDatum
19 GPSDestLatitudeRef Sensitive
20 GPSDestLatitude Sensitive
21 GPSDestLongitudeRef Sensitive
22 GPSDestLongitude Sensitive
23 GPSDestBearingRef
24 GPSDestBearing
25 GPSDestDistanceRef
26 GPSDestDistance
27 GPSProcessingMethod
28 GPSAreaInformation
29 GPSDateStamp
30 GPSDifferential
31 GPSHPositioningError
"""

#: The same of the main, sub and Exif directories.
TIFF = """
254 NewSubfileType Enum
255 SubfileType Enum
256 ImageWidth
257 ImageLength
258 BitsPerSample
259 Compression Enum
262 PhotometricInterpretation Enum
263 Thresholding
266 FillOrder
269 DocumentName
270 ImageDescription
271 Make
272 Model
273 StripOffsets
274 Orientation Enum
277 SamplesPerPixel
278 RowsPerStrip
279 StripByteCounts
282 XResolution
283 YResolution
284 PlanarConfiguration Enum
296 ResolutionUnit Enum
297 PageNumber
301 TransferFunction
305 Software
306 DateTime DateTime
315 Artist Sensitive
316 HostComputer
317 Predictor
318 WhitePoint
319 PrimaryChromaticities
320 ColorMap
322 TileWidth
323 TileLength
324 TileOffsets
325 TileByteCounts
330 SubIFDs Pointer
338 ExtraSamples
339 SampleFormat
347 JPEGTables
512 JPEGProc
513 JPEGInterchangeFormat
514 JPEGInterchangeFormatLength
529 YCbCrCoefficients
530 YCbCrSubSampling
531 YCbCrPositioning Enum
532 ReferenceBlackWhite
33421 CFARepeatPatternDim
33422 CFAPattern
33423 BatteryLevel
33432 Copyright Sensitive
33434 ExposureTime Seconds
33437 FNumber FNumber
34665 ExifIFD Pointer
34675 InterColorProfile Opaque
34853 GPSIFD Pointer
34850 ExposureProgram Enum
34852 SpectralSensitivity
34855 ISOSpeedRatings Iso
34856 OECF
34864 SensitivityType Enum
34865 StandardOutputSensitivity
34866 RecommendedExposureIndex
34867 ISOSpeed Iso
36864 ExifVersion
36867 DateTimeOriginal DateTime
36868 DateTimeDigitized DateTime
36880 OffsetTime
36881 OffsetTimeOriginal
36882 OffsetTimeDigitized
37121 ComponentsConfiguration
37122 CompressedBitsPerPixel
37377 ShutterSpeedValue
37378 ApertureValue
37379 BrightnessValue
37380 ExposureBiasValue
37381 MaxApertureValue
37382 SubjectDistance
37383 MeteringMode Enum
37384 LightSource Enum
37385 Flash Enum
37386 FocalLength Millimetres
37396 SubjectArea
37500 MakerNote Opaque
37510 UserComment
37520 SubSecTime
37521 SubSecTimeOriginal
37522 SubSecTimeDigitized
40960 FlashpixVersion
40961 ColorSpace Enum
40962 PixelXDimension
40963 PixelYDimension
40964 RelatedSoundFile
40965 InteropIFD Pointer
41483 FlashEnergy
41486 FocalPlaneXResolution
41487 FocalPlaneYResolution
41488 FocalPlaneResolutionUnit Enum
41492 SubjectLocation
41493 ExposureIndex
41495 SensingMethod Enum
41728 FileSource
41729 SceneType
41730 CFAPattern
41985 CustomRendered Enum
41986 ExposureMode Enum
41987 WhiteBalance Enum
41988 DigitalZoomRatio
41989 FocalLengthIn35mmFilm Millimetres
41990 SceneCaptureType Enum
41991 GainControl
41992 Contrast
41993 Saturation
41994 Sharpness
41996 SubjectDistanceRange
42016 ImageUniqueID Sensitive
42032 CameraOwnerName Sensitive
42033 BodySerialNumber Sensitive
42034 LensSpecification
42035 LensMake
42036 LensModel
42037 LensSerialNumber Sensitive
42080 CompositeImage
50706 DNGVersion
50707 DNGBackwardVersion
50708 UniqueCameraModel
50709 LocalizedCameraModel
50710 CFAPlaneColor
50711 CFALayout Enum
50712 LinearizationTable
50713 BlackLevelRepeatDim
50714 BlackLevel
50715 BlackLevelDeltaH
50716 BlackLevelDeltaV
50717 WhiteLevel
50718 DefaultScale
50719 DefaultCropOrigin
50720 DefaultCropSize
50721 ColorMatrix1 Matrix3x3
50722 ColorMatrix2 Matrix3x3
50723 CameraCalibration1 Matrix3x3
50724 CameraCalibration2 Matrix3x3
50725 ReductionMatrix1 Matrix3x3
50726 ReductionMatrix2 Matrix3x3
50727 AnalogBalance
50728 AsShotNeutral
50729 AsShotWhiteXY
50730 BaselineExposure
50731 BaselineNoise
50732 BaselineSharpness
50733 BayerGreenSplit
50734 LinearResponseLimit
50735 CameraSerialNumber Sensitive
50736 LensInfo
50737 ChromaBlurRadius
50738 AntiAliasStrength
50739 ShadowScale
50740 DNGPrivateData Opaque
50741 MakerNoteSafety Enum
50778 CalibrationIlluminant1 Enum
50779 CalibrationIlluminant2 Enum
50780 BestQualityScale
50781 RawDataUniqueID
50827 OriginalRawFileName
50829 ActiveArea
50830 MaskedAreas
50831 AsShotICCProfile Opaque
50832 AsShotPreProfileMatrix
50833 CurrentICCProfile Opaque
50834 CurrentPreProfileMatrix
50879 ColorimetricReference Enum
50931 CameraCalibrationSignature
50932 ProfileCalibrationSignature
50936 ProfileName
50937 ProfileHueSatMapDims
50938 ProfileHueSatMapData1 Opaque
50939 ProfileHueSatMapData2 Opaque
50940 ProfileToneCurve Opaque
50941 ProfileEmbedPolicy Enum
50942 ProfileCopyright
50964 ForwardMatrix1 Matrix3x3
50965 ForwardMatrix2 Matrix3x3
50966 PreviewApplicationName
50967 PreviewApplicationVersion
50969 PreviewSettingsDigest
50970 PreviewColorSpace Enum
50971 PreviewDateTime DateTime
50972 RawImageDigest
51041 NoiseProfile
51043 TimeCodes
51044 FrameRate
51125 DefaultUserCrop
700 XMP Opaque
33723 IPTC Opaque
"""

#: name, value and text of enumerated values.
ENUMS = """
Compression 1 uncompressed
Compression 5 LZW
Compression 6 JPEG (old)
Compression 7 JPEG
Compression 8 deflate
Compression 32773 PackBits
Compression 34892 lossy JPEG
PhotometricInterpretation 0 white is zero
PhotometricInterpretation 1 black is zero
PhotometricInterpretation 2 RGB
PhotometricInterpretation 3 palette
PhotometricInterpretation 6 YCbCr
PhotometricInterpretation 32803 CFA (Bayer mosaic)
PhotometricInterpretation 34892 linear raw
Orientation 1 upright
Orientation 2 mirrored
Orientation 3 rotated 180°
Orientation 4 mirrored, rotated 180°
Orientation 5 mirrored, rotated 90° CW
Orientation 6 rotated 90° CW
Orientation 7 mirrored, rotated 270° CW
Orientation 8 rotated 270° CW
ResolutionUnit 1 none
ResolutionUnit 2 inch
ResolutionUnit 3 cm
PlanarConfiguration 1 chunky
PlanarConfiguration 2 planar
NewSubfileType 0 full-resolution image
NewSubfileType 1 reduced-resolution image
NewSubfileType 2 single page
ExposureProgram 0 not defined
ExposureProgram 1 manual
ExposureProgram 2 normal
ExposureProgram 3 aperture priority
ExposureProgram 4 shutter priority
ExposureProgram 5 creative
ExposureProgram 6 action
ExposureProgram 7 portrait
ExposureProgram 8 landscape
MeteringMode 0 unknown
MeteringMode 1 average
MeteringMode 2 centre-weighted
MeteringMode 3 spot
MeteringMode 4 multi-spot
MeteringMode 5 pattern
MeteringMode 6 partial
LightSource 0 unknown
LightSource 1 daylight
LightSource 2 fluorescent
LightSource 3 tungsten
LightSource 4 flash
LightSource 9 fine weather
LightSource 10 cloudy
LightSource 11 shade
Flash 0 did not fire
Flash 1 fired
Flash 16 off, did not fire
Flash 24 auto, did not fire
Flash 25 auto, fired
ColorSpace 1 sRGB
ColorSpace 2 Adobe RGB
ColorSpace 65535 uncalibrated
WhiteBalance 0 auto
WhiteBalance 1 manual
ExposureMode 0 auto
ExposureMode 1 manual
ExposureMode 2 auto bracket
CustomRendered 0 normal
CustomRendered 1 custom
SceneCaptureType 0 standard
SceneCaptureType 1 landscape
SceneCaptureType 2 portrait
SceneCaptureType 3 night
SensingMethod 1 not defined
SensingMethod 2 one-chip colour area
SensingMethod 7 trilinear
FocalPlaneResolutionUnit 1 none
FocalPlaneResolutionUnit 2 inch
FocalPlaneResolutionUnit 3 cm
YCbCrPositioning 1 centered
YCbCrPositioning 2 co-sited
CFALayout 1 rectangular
MakerNoteSafety 0 unsafe
MakerNoteSafety 1 safe
PreviewColorSpace 1 gray gamma 2.2
PreviewColorSpace 2 sRGB
PreviewColorSpace 3 Adobe RGB
PreviewColorSpace 4 ProPhoto RGB
ColorimetricReference 0 scene-referred
ColorimetricReference 1 output-referred
"""

#: value and text of light sources for both calibration illuminants.
ILLUMINANTS = """
0 unknown
1 daylight
2 fluorescent
3 tungsten
17 Standard A
18 Standard B
19 Standard C
20 D55
21 D65
22 D75
23 D50
"""

#: Ratios of sides in the order in which they are tried.
RATIOS = ((1, 1), (5, 4), (4, 3), (7, 5), (3, 2), (16, 10), (5, 3), (16, 9), (2, 1), (21, 9))

#: TIFF field types: code, name, bytes.
TYPES = ((1, "BYTE", 1), (2, "ASCII", 1), (3, "SHORT", 2), (4, "LONG", 4), (5, "RATIONAL", 8), (6, "SBYTE", 1), (7, "UNDEFINED", 1), (8, "SSHORT", 2), (9, "SLONG", 4), (10, "SRATIONAL", 8), (11, "FLOAT", 4), (12, "DOUBLE", 8), (13, "IFD", 4))


def tag_rows() -> list[tuple[str, int, str, str]]:
    """(ns, tag, name, kind): ns is interop, gps or tiff."""
    out = []
    for ns, table in (("interop", INTEROP), ("gps", GPS), ("tiff", TIFF)):
        for line in table.split("\n"):
            if line:
                number, name, *kind = line.split(" ")
                out.append((ns, int(number), name, kind[0] if kind else "Plain"))
    return out


def enum_rows() -> list[tuple[str, int, str]]:
    """(name, value, text)."""
    out = [(n, int(v), t) for n, v, t in (line.split(" ", 2) for line in ENUMS.split("\n") if line)]
    for line in ILLUMINANTS.split("\n"):
        if line:
            value, text = line.split(" ", 1)
            out += [(f"CalibrationIlluminant{i}", int(value), text) for i in (1, 2)]
    return out
