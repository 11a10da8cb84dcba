"""Names that formats and their readers share, as plain fixed values."""

# Image tags of EXIF by number.
IMAGE_TAGS = {
    0x000B: "ProcessingSoftware", 0x00FE: "NewSubfileType", 0x00FF: "SubfileType", 0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression",
    0x0106: "PhotometricInterpretation", 0x0107: "Threshholding", 0x010A: "FillOrder", 0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation",
    0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0118: "MinSampleValue", 0x0119: "MaxSampleValue", 0x011D: "PageName", 0x0122: "GrayResponseUnit", 0x0123: "GrayResponseCurve", 0x0124: "T4Options", 0x0125: "T6Options", 0x0128: "ResolutionUnit", 0x0129: "PageNumber",
    0x012D: "TransferFunction", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x013D: "Predictor", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities",
    0x0140: "ColorMap", 0x0141: "HalftoneHints", 0x014C: "InkSet", 0x014D: "InkNames", 0x014E: "NumberOfInks", 0x0150: "DotRange", 0x0151: "TargetPrinter", 0x0154: "SMinSampleValue", 0x0155: "SMaxSampleValue", 0x0200: "JPEGProc", 0x0207: "JPEGQTables", 0x0208: "JPEGDCTables", 0x0209: "JPEGACTables", 0x0142: "TileWidth", 0x0143: "TileLength", 0x0144: "TileOffsets", 0x0145: "TileByteCounts", 0x014A: "SubIFDs", 0x0152: "ExtraSamples", 0x0153: "SampleFormat",
    0x015B: "JPEGTables", 0x0201: "JPEGInterchangeFormat", 0x0202: "JPEGInterchangeFormatLength", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling", 0x0213: "YCbCrPositioning",
    0x0214: "ReferenceBlackWhite", 0x02BC: "XMLPacket", 0x4746: "Rating", 0x8298: "Copyright", 0x83BB: "IPTCNAA", 0x8649: "ImageResources", 0x8773: "InterColorProfile",
    0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xC4A5: "PrintImageMatching", 0xC614: "UniqueCameraModel",
    0xC62F: "CameraSerialNumber", 0xC65D: "RawDataUniqueID", 0xC68B: "OriginalRawFileName",
    0x0108: "CellWidth", 0x0109: "CellLength", 0x0120: "FreeOffsets", 0x0121: "FreeByteCounts", 0x0156: "TransferRange", 0x0157: "ClipPath", 0x0158: "XClipPathUnits", 0x0159: "YClipPathUnits",
    0x015A: "Indexed", 0x015F: "OPIProxy", 0x0202: "JPEGInterchangeFormatLength", 0x0203: "JPEGRestartInterval", 0x0205: "JPEGLosslessPredictors", 0x0206: "JPEGPointTransforms", 0x4749: "RatingPercent",
    0x800D: "ImageID", 0x828D: "CFARepeatPatternDim", 0x828E: "CFAPattern", 0x828F: "BatteryLevel", 0x882A: "TimeZoneOffset", 0x882B: "SelfTimerMode", 0x920D: "Noise", 0x9211: "ImageNumber",
    0x9212: "SecurityClassification", 0x9213: "ImageHistory", 0x9216: "TIFFEPStandardID",
}
# Image tags of digital negatives, runs of consecutive numbers.
NEGATIVE_TAGS = {
    0xC612: ("DNGVersion", "DNGBackwardVersion"),
    0xC615: ("LocalizedCameraModel", "CFAPlaneColor", "CFALayout", "LinearizationTable", "BlackLevelRepeatDim", "BlackLevel", "BlackLevelDeltaH", "BlackLevelDeltaV", "WhiteLevel", "DefaultScale", "DefaultCropOrigin",
             "DefaultCropSize", "ColorMatrix1", "ColorMatrix2", "CameraCalibration1", "CameraCalibration2", "ReductionMatrix1", "ReductionMatrix2", "AnalogBalance", "AsShotNeutral", "AsShotWhiteXY", "BaselineExposure",
             "BaselineNoise", "BaselineSharpness", "BayerGreenSplit", "LinearResponseLimit"),
    0xC630: ("LensInfo", "ChromaBlurRadius", "AntiAliasStrength", "ShadowScale", "DNGPrivateData", "MakerNoteSafety"),
    0xC65A: ("CalibrationIlluminant1", "CalibrationIlluminant2", "BestQualityScale"),
    0xC68C: ("OriginalRawFileData", "ActiveArea", "MaskedAreas", "AsShotICCProfile", "AsShotPreProfileMatrix", "CurrentICCProfile", "CurrentPreProfileMatrix"),
    0xC6BF: ("ColorimetricReference",),
    0xC6F3: ("CameraCalibrationSignature", "ProfileCalibrationSignature", "ExtraCameraProfiles", "AsShotProfileName", "NoiseReductionApplied", "ProfileName", "ProfileHueSatMapDims", "ProfileHueSatMapData1", "ProfileHueSatMapData2",
             "ProfileToneCurve", "ProfileEmbedPolicy", "ProfileCopyright"),
    0xC714: ("ForwardMatrix1", "ForwardMatrix2", "PreviewApplicationName", "PreviewApplicationVersion", "PreviewSettingsName", "PreviewSettingsDigest", "PreviewColorSpace", "PreviewDateTime", "RawImageDigest",
             "OriginalRawFileDigest", "SubTileBlockSize", "RowInterleaveFactor"),
    0xC725: ("ProfileLookTableDims", "ProfileLookTableData"),
    0xC740: ("OpcodeList1", "OpcodeList2"),
    0xC74E: ("OpcodeList3",),
    0xC761: ("NoiseProfile",),
}
IMAGE_TAGS |= {first + k: name for first, names in NEGATIVE_TAGS.items() for k, name in enumerate(names)}
# EXIF tags by number.
EXIF_TAGS = {
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8824: "SpectralSensitivity", 0x8827: "ISOSpeedRatings", 0x8828: "OECF", 0x8831: "StandardOutputSensitivity", 0x8832: "RecommendedExposureIndex", 0x8833: "ISOSpeed", 0x8834: "ISOSpeedLatitudeyyy", 0x8835: "ISOSpeedLatitudezzz", 0xA20C: "SpatialFrequencyResponse", 0x8830: "SensitivityType",
    0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized",
    0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue",
    0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea",
    0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace",
    0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA004: "RelatedSoundFile", 0xA20B: "FlashEnergy", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution",
    0xA210: "FocalPlaneResolutionUnit", 0xA214: "SubjectLocation", 0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern",
    0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl",
    0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA40B: "DeviceSettingDescription", 0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName",
    0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber", 0xA500: "Gamma",
}
# GPS tags by number.
GPS_TAGS = dict(enumerate((
    "GPSVersionID", "GPSLatitudeRef", "GPSLatitude", "GPSLongitudeRef", "GPSLongitude", "GPSAltitudeRef", "GPSAltitude", "GPSTimeStamp", "GPSSatellites", "GPSStatus", "GPSMeasureMode",
    "GPSDOP", "GPSSpeedRef", "GPSSpeed", "GPSTrackRef", "GPSTrack", "GPSImgDirectionRef", "GPSImgDirection", "GPSMapDatum", "GPSDestLatitudeRef", "GPSDestLatitude", "GPSDestLongitudeRef",
    "GPSDestLongitude", "GPSDestBearingRef", "GPSDestBearing", "GPSDestDistanceRef", "GPSDestDistance", "GPSProcessingMethod", "GPSAreaInformation", "GPSDateStamp", "GPSDifferential", "GPSHPositioningError",
)))
# kbit/s by version and layer of MPEG sound, and sample rates of MPEG-1, by their codes.
FRAME_RATES = {
    ("1", 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, 0),
    ("1", 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 0),
    ("1", 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0),
    ("2", 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, 0),
    ("2", 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0),
    ("2", 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0),
}
SAMPLE_RATES = (44100, 48000, 32000, 0)
# Names of codecs.
CODECS = {"avc1": "H.264/AVC", "hvc1": "H.265/HEVC", "hev1": "H.265/HEVC", "vp08": "VP8", "vp09": "VP9", "av01": "AV1", "mp4a": "AAC", ".mp3": "MP3", "ac-3": "AC-3", "ec-3": "E-AC-3", "Opus": "Opus", "fLaC": "FLAC", "alac": "ALAC"}

# Headers of mail, as parts of the name; and those that stay whatever they contain.
SENSITIVE_HEADERS = (
    "received", "x-originating-ip", "x-sender-ip", "x-mailer", "x-mimeole", "user-agent", "x-ms-exchange", "x-ms-tnef-correlator", "x-ms-has-attach", "x-ms-publictraffictype", "x-microsoft",
    "x-originatororg", "x-forefront", "authentication-results", "received-spf", "arc-seal", "arc-message-signature", "arc-authentication-results", "dkim-signature", "x-google-dkim-signature",
    "x-gm-message-state", "x-google-smtp-source", "x-received", "x-yahoo", "x-ymail", "x-spam", "x-virus", "x-antivirus", "x-priority", "x-msmail-priority", "x-msonline", "x-organization",
    "organization", "x-job", "x-pm", "x-proofpoint", "message-id",
)
#: Not in that list, but as telling: they name a sender's or receiver's address or machine.
MORE_HEADERS = ("x-sender", "x-forwarded", "reply-to", "return-path", "delivered-to", "references", "in-reply-to")
ESSENTIAL_HEADERS = ("from", "to", "cc", "bcc", "subject", "date", "content-type", "content-transfer-encoding", "mime-version", "content-disposition")
# Media types that can be cleaned where they are embedded, and the kind of file each is.
EMBEDDED = {
    "image/jpeg": "jpeg", "image/jpg": "jpeg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "application/pdf": "pdf", "message/rfc822": "eml",
    "image/svg+xml": "svg", "image/tiff": "tiff", "audio/mpeg": "mp3", "audio/wav": "wav", "audio/x-wav": "wav", "audio/flac": "flac", "audio/mp4": "m4a", "video/mp4": "video", "video/quicktime": "video",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "office", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "office",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "office",
}
# Kinds of files inside files by their endings, where a mail does not tell.
ENDINGS = {
    "jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "gif": "gif", "pdf": "pdf", "eml": "eml", "svg": "svg", "tif": "tiff", "tiff": "tiff", "mp3": "mp3", "wav": "wav", "flac": "flac", "m4a": "m4a",
    "mp4": "video", "mov": "video", "docx": "office", "xlsx": "office", "pptx": "office", "heic": "heic",
}
# Namespaces in SVG, by the prefix that they usually have.
HOME_NAMES = {
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf", "http://purl.org/dc/elements/1.1/": "dc", "http://creativecommons.org/ns#": "cc", "http://web.resource.org/cc/": "cc",
    "http://www.inkscape.org/namespaces/inkscape": "inkscape", "http://sodipodi.sourceforge.net/DTD/sodipodi-0.dtd": "sodipodi", "http://ns.adobe.com/xap/1.0/": "xmp", "http://www.w3.org/1999/xlink": "xlink",
}
# What cleaned files may consist of, by format; all else goes.
KEPT_SEGMENTS = ("C0", "C1", "C2", "C3", "C4", "C5", "C6", "C7", "C9", "CA", "CB", "CC", "CD", "CE", "CF", "DA", "DB", "DC", "DD", "DE", "DF")
KEPT_CHUNKS = {"IHDR": 13, "tRNS": None, "gAMA": 4, "cHRM": 32, "sRGB": 1, "bKGD": None, "sBIT": None, "pHYs": 9, "cICP": 4, "PLTE": None, "IDAT": None, "acTL": 8, "fcTL": 26, "fdAT": None, "IEND": 0}
KEPT_IN_WEBP = ("VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF")
KEPT_IN_WAV = ("fmt ", "data", "fact")
KEPT_BOXES = (
    "ftyp", "styp", "moov", "mvhd", "iods", "trak", "tkhd", "edts", "elst", "mdia", "mdhd", "hdlr", "minf", "vmhd", "smhd", "nmhd", "sthd", "gmhd", "dinf", "dref", "stbl", "stsd", "stts", "ctts", "cslg", "stsc",
    "stsz", "stz2", "stco", "co64", "stss", "stsh", "sdtp", "stps", "sbgp", "sgpd", "mvex", "mehd", "trex", "moof", "mfhd", "traf", "tfhd", "tfdt", "trun", "mdat",
)
KEPT_IN_STSD = ("avcC", "hvcC", "vpcC", "av1C", "esds", "dOps", "dfLa", "dac3", "dec3", "alac", "colr", "pasp", "clap", "fiel", "btrt", "mdcv", "clli", "dvcC", "dvvC", "tx3g")
KEPT_TIFF = (
    "NewSubfileType", "SubfileType", "ImageWidth", "ImageLength", "BitsPerSample", "Compression", "PhotometricInterpretation", "Threshholding", "FillOrder", "StripOffsets", "Orientation", "SamplesPerPixel",
    "RowsPerStrip", "StripByteCounts", "MinSampleValue", "MaxSampleValue", "XResolution", "YResolution", "PlanarConfiguration", "GrayResponseUnit", "GrayResponseCurve", "T4Options", "T6Options", "ResolutionUnit",
    "PageNumber", "TransferFunction", "Predictor", "WhitePoint", "PrimaryChromaticities", "ColorMap", "HalftoneHints", "TileWidth", "TileLength", "TileOffsets", "TileByteCounts", "SubIFDs", "InkSet", "NumberOfInks",
    "DotRange", "ExtraSamples", "SampleFormat", "SMinSampleValue", "SMaxSampleValue", "JPEGTables", "JPEGProc", "JPEGInterchangeFormat", "JPEGInterchangeFormatLength", "JPEGQTables", "JPEGDCTables", "JPEGACTables",
    "YCbCrCoefficients", "YCbCrSubSampling", "YCbCrPositioning", "ReferenceBlackWhite",
)
# Namespaces of editors and attributes that tell about people, in SVG.
EDITORS = ("inkscape", "sodipodi", "illustrator", "adobe", "sketch", "figma", "corel", "serif")
TELLING_ATTRIBUTES = ("inkscape:version", "sodipodi:docname", "inkscape:export-filename", "inkscape:export-xdpi", "inkscape:export-ydpi", "adobe:docid", "xmp:CreatorTool", "dc:creator", "dc:rights", "dc:date", "dc:description", "cc:license", "data-name", "data-author")
# Makers whose name in the software tag marks a scan or a print.
SCANNERS = ("Xerox", "Canon", "HP ", "Epson", "Brother", "Ricoh", "Konica", "Lexmark", "ScanSnap", "WIA", "TWAIN", "Scanner", "Copier")

# Names to show for fields, by the file's kind; what is not listed shows as it is.
LABELS = {
    "exif": {
        "GPSLatitude": "GPS latitude", "GPSLongitude": "GPS longitude", "GPSAltitude": "GPS altitude", "GPSLatitudeRef": "Latitude reference", "GPSLongitudeRef": "Longitude reference", "GPSTimeStamp": "GPS time",
        "GPSDateStamp": "GPS date", "Make": "Maker", "Model": "Model", "Software": "Software", "HostComputer": "Computer", "SerialNumber": "Serial number", "BodySerialNumber": "Body serial number",
        "LensSerialNumber": "Lens serial number", "CameraOwnerName": "Camera owner", "OwnerName": "Owner", "Artist": "Artist", "Copyright": "Copyright", "ImageDescription": "Description", "UserComment": "User comment",
        "XPAuthor": "Author", "XPComment": "Comment", "DateTimeOriginal": "Taken", "CreateDate": "Created", "ModifyDate": "Modified", "DateTimeDigitized": "Digitised", "DateTime": "Date and time", "LensModel": "Lens model",
        "LensMake": "Lens maker", "LensInfo": "Lens", "FocalLength": "Focal length", "FNumber": "Aperture", "ExposureTime": "Exposure", "ISOSpeedRatings": "ISO", "ExifVersion": "EXIF version", "ColorSpace": "Colour space",
        "PixelXDimension": "Width", "PixelYDimension": "Height",
    },
    "pdf": {"Creator": "Creating program", "Producer": "PDF producer", "CreationDate": "Created", "ModDate": "Modified", "PDFFormatVersion": "PDF version"},
    "office": {"creator": "Creator", "lastModifiedBy": "Last modified by", "created": "Created", "modified": "Modified", "title": "Title", "subject": "Subject", "revision": "Revision", "AppVersion": "Application version", "TotalTime": "Editing time", "description": "Description", "keywords": "Keywords"},
    "mp3": {"TIT2": "Title", "TPE1": "Artist", "TPE2": "Album Artist", "TALB": "Album", "TYER": "Year", "TDRC": "Recording Date", "TCON": "Genre", "TRCK": "Track Number", "TPOS": "Disc Number", "TCOM": "Composer", "TENC": "Encoded By", "TSSE": "Encoding Software", "TOPE": "Original Artist", "TCOP": "Copyright", "TPUB": "Publisher", "COMM": "Comment", "APIC": "Album Art", "TXXX": "Custom Field", "PRIV": "Private Data", "WOAR": "Artist URL", "WOAS": "Source URL", "WORS": "Radio Station URL", "GEOB": "Encapsulated Object"},
    "wav": {"IART": "Artist", "ICMT": "Comment", "ICOP": "Copyright", "ICRD": "Creation Date", "IENG": "Engineer", "IGNR": "Genre", "IKEY": "Keywords", "IMED": "Medium", "INAM": "Title", "IPRD": "Product", "ISBJ": "Subject", "ISFT": "Software", "ISRC": "Source", "ISRF": "Source Form", "ITCH": "Technician"},
    "mp4": {"©nam": "Title", "©ART": "Artist", "©alb": "Album", "©day": "Date", "©gen": "Genre", "©cmt": "Comment", "©wrt": "Writer", "©too": "Encoder", "©enc": "Encoded By", "aART": "Album Artist", "auth": "Author", "titl": "Title", "dscp": "Description", "cprt": "Copyright", "covr": "Cover Art", "desc": "Description", "mvhd": "Created"},
    "vorbis": {"TITLE": "Title", "ARTIST": "Artist", "ALBUM": "Album", "DATE": "Date", "GENRE": "Genre", "TRACKNUMBER": "Track", "COMMENT": "Comment", "ENCODER": "Encoder", "ENCODED-BY": "Encoded By", "COPYRIGHT": "Copyright"},
}
#: Which of those a kind of file uses.
LABELLED = {"jpeg": "exif", "tiff": "exif", "pdf": "pdf", "office": "office", "mp3": "mp3", "wav": "wav", "video": "mp4", "m4a": "mp4", "flac": "vorbis", "ogg": "vorbis"}
