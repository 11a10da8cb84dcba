"""Fixed values that results depend on: names, lists and thresholds."""

from __future__ import annotations

# Tracking parameters by platform, in matching order.
# A trailing * stands for any ending.  Names are compared with lower-case keys.
TRACKERS = {
    "google": ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format", "utm_marketing_tactic", "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "gad_source"),
    "facebook": ("fbclid", "fb_action_ids", "fb_action_types", "fb_source", "fb_ref", "fb_beacon_info", "fb_comment_id", "fb_dtsg", "fb_dtsg_ag", "hrc", "fref", "igshid", "igsh"),
    "twitter": ("twclid", "s", "t", "ref_src", "ref_url", "src"),
    "microsoft": ("msclkid", "mkt_tok", "cvid"),
    "tiktok": ("ttclid", "tt_medium", "tt_content", "share_item_id", "share_app_id", "_r", "u_code", "preview_pb", "language", "timestamp", "is_from_webapp", "sender_device", "enter_from"),
    "amazon": ("tag", "ref", "ref_", "pf_rd_*", "pd_rd_*", "qid", "sr", "keywords", "content-id", "psc", "smid", "spIA", "linkCode", "th", "dib_tag", "dib"),
    "youtube": ("si", "feature", "pp", "embeds_referring_euri", "source_ve_path", "ab_channel", "list", "index", "start", "t"),
    "linkedin": ("trackingId", "lipi", "lici", "trk", "trkEmail", "trkInfo", "connectionId", "rcm"),
    "email": ("mc_cid", "mc_eid", "mc_tc", "hsa_acc", "hsa_cam", "hsa_grp", "hsa_ad", "hsa_src", "hsa_tgt", "hsa_kw", "hsa_mt", "hsa_net", "hsa_ver", "hsa_la", "hsa_ol", "__hstc", "__hssc", "__hsfp", "hsCtaTracking", "mkt_tok", "_kx", "sg_", "email_source", "email_campaign", "e_src", "e_cid"),
    "social": ("share", "shared", "share_id", "social_source", "via", "spm", "scm", "pvid", "algo_expid", "algo_pvid", "btsid"),
    "analytics": ("_ga", "_gl", "_hsenc", "_openstat", "yclid", "ymclid", "wickedid", "wickedsource", "rb_clickid", "mc_tc", "ns_*", "browser_id", "session_id", "visitor_id", "tracking_id", "trk_*", "click_id", "cid", "campaign_id"),
    "affiliate": ("aff_id", "affiliate_id", "aff_sub*", "affid", "affiliate", "partner", "partner_id", "ref_id", "refid", "referrer", "siteID", "ICID", "irgwc", "clickref"),
    "media": ("ncid", "ocid", "mod", "sec", "subsec", "pos", "share_id", "utm_name", "context", "correlation_id", "e_t", "lp", "ptl", "sc_*"),
    "chinese": ("weibo_id", "weiboauthoruid", "wechat_redirect", "from", "isappinstalled", "spm", "scm", "pvid", "algo_expid", "algo_pvid", "btsid", "ns_*", "_p_tr_v", "tpp_rcmd_*"),
    "ecommerce": ("variant", "variant_id", "currency", "discount", "coupon", "promo", "promo_code", "sale_source"),
}
PRESERVED = ("v", "id", "q", "search", "query", "page", "p", "sort", "order", "filter", "category", "cat", "lang", "language", "locale", "token", "auth", "key", "access_token", "code", "state", "redirect", "return", "next", "callback", "continue", "start_time", "end_time", "date", "from", "to")
HIGH_PARAMS = ("fbclid", "gclid", "msclkid", "ttclid", "twclid", "_ga", "_gl", "mc_eid")
MEDIUM_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "ref", "source")
# What a key looks like that is taken for a tracker, and a value longer than so many characters.
SUSPECT_KEYS = ("^(click|track|campaign|source|ref|ad|promo|affiliate)", "(id|token|hash|signature|sig)$", "^_[a-z]{2,}$", "^[a-z]+clid$")
SUSPECT_VALUE = "^[a-zA-Z0-9_-]+$"
SUSPECT_LENGTH = 20

# Risk of metadata fields by format; what is not listed is low.
EXIF_RISK = {
    "high": ("GPSLatitude", "GPSLongitude", "GPSAltitude", "GPSLatitudeRef", "GPSLongitudeRef", "GPSAltitudeRef", "GPSTimeStamp", "GPSDateStamp", "GPSMapDatum", "SerialNumber", "BodySerialNumber", "LensSerialNumber", "CameraOwnerName", "OwnerName", "Artist", "Copyright", "ImageDescription", "UserComment", "XPAuthor", "XPComment"),
    "medium": ("Make", "Model", "Software", "HostComputer", "DateTimeOriginal", "CreateDate", "ModifyDate", "DateTimeDigitized", "DateTime", "LensModel", "LensMake", "LensInfo", "ImageUniqueID", "CameraSerialNumber"),
}
PDF_RISK = {"high": ("Author", "Creator", "Producer"), "medium": ("Title", "Subject", "Keywords", "CreationDate", "ModDate")}
#: Compared without case, as a part of the field's name, in this order.
OFFICE_RISK = {
    "high": ("creator", "lastModifiedBy"),
    "medium": ("created", "modified", "title", "subject"),
    "low": ("revision", "Application", "AppVersion", "Company", "TotalTime"),
}

# Categories by parts of the lower-case field name, in order.
CATEGORIES = {
    "location": ("gps", "latitude", "longitude", "altitude", "location"),
    "device": ("make", "model", "software", "lens", "serial", "camera"),
    "personal": ("author", "creator", "artist", "copyright", "owner", "lastmodifiedby"),
    "temporal": ("date", "time", "created", "modified"),
}
WEIGHTS = {"high": 35, "medium": 15, "low": 5}
LEVELS = (("critical", 70), ("high", 50), ("medium", 25))

# What links files with each other.
DEVICE_PARTS = ("serial", "imageuniqueid", "lensserialnumber", "bodyserialnumber")
AUTHOR_PARTS = ("creator", "author", "artist", "lastmodifiedby")
RADIUS_KM = 2.0
EARTH_KM = 6371.0

# Screenshots.
SHOT_NAMES = (
    r"screenshot", r"screen\s*shot", r"screen\s*capture", r"ekran\s*görüntüsü", r"ekran\s*goruntusu", r"captura\s*de\s*pantalla",
    r"capture\s*d'écran", r"bildschirmfoto", r"снимок\s*экрана", r"截图", r"截屏", r"スクリーンショット", r"لقطة\s*شاشة",
    r"img_\d{4}", r"screenshot_\d{4}", r"screen\s*recording",
)
IPHONE = ((1170, 2532), (1284, 2778), (1179, 2556), (1290, 2796), (1125, 2436), (828, 1792), (1242, 2688), (750, 1334), (1242, 2208), (640, 1136), (640, 960))
IPAD = ((2048, 2732), (1668, 2388), (1640, 2360), (1620, 2160))
DESKTOP = ((1920, 1080), (2560, 1440), (3840, 2160), (1366, 768), (2880, 1800))
OTHER_SCREENS = (
    (1080, 1920), (1440, 2560), (1080, 2340), (1080, 2400), (1440, 3040), (1440, 3200), (1080, 2280), (720, 1280), (720, 1520),
    (720, 1600), (1080, 2160), (1440, 2880), (1536, 864), (1280, 720), (1600, 900), (1280, 800), (2560, 1600),
)
SHOT_SOFTWARE = r"screenshot|screen\s*capture|snipping\s*tool|snip\s*&\s*sketch|greenshot|lightshot|sharex|flameshot|spectacle|gyazo|monosnap|skitch|grab|preview"
PHONE_MAKERS = ("apple", "samsung", "huawei", "xiaomi", "oppo", "vivo", "oneplus", "google", "pixel", "motorola", "lg", "sony", "nokia", "realme")

# Tags that selective cleaning removes, by category.
SELECTABLE = {
    "gps": ("GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "GPSAltitude", "GPSAltitudeRef", "GPSTimeStamp", "GPSDateStamp", "GPSSpeed", "GPSSpeedRef", "GPSTrack", "GPSTrackRef", "GPSImgDirection", "GPSImgDirectionRef", "GPSDestLatitude", "GPSDestLongitude", "GPSAreaInformation"),
    "device": ("Make", "Model", "Software", "HostComputer", "BodySerialNumber", "CameraSerialNumber", "LensSerialNumber", "InternalSerialNumber", "LensModel", "LensMake"),
    "datetime": ("DateTime", "DateTimeOriginal", "DateTimeDigitized", "CreateDate", "ModifyDate", "SubSecTime", "SubSecTimeOriginal", "SubSecTimeDigitized", "OffsetTime", "OffsetTimeOriginal"),
    "personal": ("Artist", "Copyright", "Author", "Creator", "Owner", "OwnerName", "CameraOwnerName", "ImageDescription", "UserComment", "XPAuthor", "XPComment", "XPKeywords", "XPSubject"),
    "technical": ("ExposureTime", "FNumber", "ISOSpeedRatings", "FocalLength", "WhiteBalance", "Flash", "MeteringMode", "ExposureProgram", "ExposureCompensation", "MaxApertureValue", "ShutterSpeedValue"),
}
SELECTED = ("gps", "device", "datetime", "personal")
