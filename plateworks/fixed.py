"""Word lists, thresholds, platform limits, versions and the stage graph.

Everything here is contract data (a changed entry changes results), so it is kept in one
module, in natural order, as plain text.
"""

from __future__ import annotations

# --- versions that take part in fingerprints -------------------------------------------------
FACTS_VERSION = "normalize-facts-v4"
NORMALIZER_VERSION = "normalize-v1"
VIEW_VERSION = "analysis-view-v1"
QC_RULES_VERSION = "qc-rules-v4"
ENHANCEMENT_RULES_VERSION = "enhancement-rules-v2"
BUILDER_VERSION = "metadata-v1"
GATE_POLICY_VERSION = "gate-v1.3"
READINESS_VERSION = "readiness-v2"
PUBLICATION_POLICY_VERSION = "publication-v1"
EXPORT_VERSION = "export-v1"

# --- files -----------------------------------------------------------------------------------
SUPPORTED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".avif")
# hex prefix of the first bytes -> container
SIGNATURES = (("FFD8FF", "JPEG"), ("89504E470D0A1A0A", "PNG"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF"))
FTYP_BRANDS = {"heic": "HEIF", "heix": "HEIF", "hevc": "HEIF", "mif1": "HEIF", "msf1": "HEIF", "avif": "AVIF", "avis": "AVIF"}
EXTENSION_CONTAINER = {".jpg": "JPEG", ".jpeg": "JPEG", ".png": "PNG", ".tif": "TIFF", ".tiff": "TIFF",
                       ".heic": "HEIF", ".heif": "HEIF", ".avif": "AVIF", ".webp": "WEBP"}
PASS_THROUGH_CONTAINERS = ("JPEG", "PNG", "TIFF")
DERIVED_CONTAINERS = ("AVIF", "HEIF")
DECODABLE_CONTAINERS = ("JPEG", "PNG", "TIFF", "AVIF")
SOURCE_NEGATIVE_CODES = ("SOURCE_MISSING", "SOURCE_CHANGED")
RAW_OUTPUT_CHARS = 4000

# --- stages ----------------------------------------------------------------------------------
REQUIRED_STAGES = ("normalize", "view", "qc", "vision", "metadata", "readiness")
ADVISORY_STAGES = ("enhancement", "creative_review")
DEPENDS_ON = {
    "normalize": (),
    "view": ("normalize",),
    "qc": ("view",),
    "enhancement": ("view",),
    "vision": ("view",),
    "metadata": ("vision",),
    "readiness": ("normalize", "qc", "metadata"),
    "creative_review": ("view", "vision", "readiness"),
    "publication": ("readiness",),
}
FAILURE_KIND = {"normalize": "blocked", "view": "blocked", "qc": "blocked", "vision": "error", "readiness": "error"}
ASSET_STATES = ("rejected", "source_invalid", "blocked", "error", "stale", "processing", "human_review",
                "metadata_approved", "platform_ready", "publication_approved", "ready_for_export")
METADATA_STATES = ("none", "draft", "auto_approved", "human_review", "approved", "rejected")
GATEABLE_STATES = ("draft", "auto_approved", "human_review")
REJECTABLE_STATES = ("draft", "auto_approved", "human_review", "approved")
APPROVED_METADATA_STATES = ("auto_approved", "approved")
RERUN_CHAIN = {
    "normalize": ("normalize", "view", "qc", "enhancement", "vision", "metadata", "readiness"),
    "qc": ("qc", "enhancement", "vision", "metadata", "readiness"),
    "enhancement": ("enhancement",),
    "vision": ("vision", "metadata", "readiness"),
    "metadata": ("metadata", "readiness"),
    "readiness": ("readiness",),
    "creative_review": ("creative_review",),
    "publication": ("publication",),
}
RERUN_NEEDS = {
    "normalize": (),
    "view": ("normalize",),
    "qc": ("normalize", "view"),
    "enhancement": ("normalize", "view"),
    "vision": ("normalize", "view", "qc"),
    "metadata": ("normalize", "view", "qc", "vision"),
    "readiness": ("normalize", "view", "qc", "vision", "metadata"),
    "creative_review": ("normalize", "view", "qc", "vision", "metadata", "readiness"),
    "publication": ("normalize", "view", "qc", "vision", "metadata", "readiness"),
}

# --- QC thresholds ---------------------------------------------------------------------------
QC_RULES = {
    "version": QC_RULES_VERSION,
    "min_megapixels": 4.0,
    "recommended_megapixels": 12.0,
    "min_file_size": 100 * 1024,
    "max_file_size": 45 * 1024 * 1024,
    "extreme_ratio": 0.20,
    "dark_level": 5,
    "bright_level": 250,
    "edge_dark": 25,
    "edge_diff": 20,
    "edge_share": 0.4,
    "edge_outer_lines": 8,
    "edge_inner_offset": 2,
    "edge_inner_lines": 8,
    "edge_consistency_px": 3,
    "edge_consistency_ratio": 0.25,
    "edge_max_width_ratio": 0.03,
}
EDGE_REASON_PREFIX = "EDGE_BORDER: чёрные полосы — "

# --- enhancement thresholds: (metric, reason, higher is better, ok, borderline, issue, operation)
ENHANCEMENT_THRESHOLDS = (
    ("sharpness_peak", "sharpness", True, 120.0, 40.0, 20.0, "sharpen"),
    ("noise_sigma", "noise", False, 3.0, 5.0, 12.0, "denoise"),
    ("blockiness", "artifacts", False, 1.2, 1.5, 3.0, "remove_compression_artifacts"),
    ("megapixels", "resolution", True, 6.0, 4.0, 1.0, "upscale"),
)
JPEG_QUALITY_BOUNDS = (80.0, 60.0, 30.0)
SOFT_DETAIL_RATIO = 0.2
ISOLATED_SUBJECT_RATIO = 0.15
TILE = 256
SHARP_TILE = 150.0
PEAK_SHARE = 0.10
PEAK_MIN_TILES = 3
CROP = 1024
FLAT_PERCENTILE = 0.3

# --- metadata limits -------------------------------------------------------------------------
TITLE_MAX = 200
TITLE_RECOMMENDED = 70
DESCRIPTION_MAX = 200
KEYWORDS_MIN = 7
KEYWORDS_RECOMMENDED = 25
KEYWORDS_MAX = 49
KEYWORD_MAX_LENGTH = 50
KEYWORD_STOPWORDS = ("photo", "image", "picture", "stock", "stock photo")
EDITABLE_FIELDS = ("title", "description", "keywords")

# --- review gate word lists ------------------------------------------------------------------
LEGAL_FORMS = (
    "inc", "inc.", "ltd", "ltd.", "llc", "gmbh", "ag", "corp", "corp.", "plc", "s.a.", "srl", "bv", "b.v.",
    "ооо", "оао", "зао", "пао", "ао", "нпо", "фгуп", "гуп", "муп", "ип",
)
LEGAL_SYMBOLS = ("®", "™", "©")
LEGAL_WORDS = ("copyright", "patent", "patented", "trademark", "all rights reserved")
WARNING_WORDS = (
    "warning", "caution", "danger", "high voltage", "notice", "exit", "emergency", "fire", "stop",
    "no entry", "keep out",
    "внимание", "осторожно", "опасно", "высокое напряжение", "не включать", "запрещено", "выход", "стоп",
)
CONFORMITY_MARKS = ("ce", "eac", "ul", "rohs", "fcc", "ccc", "ukca", "tüv", "tuv", "vde", "гост", "ст")
RECOGNIZABLE_MARKERS = (
    "face", "faces", "facial", "portrait", "headshot", "smiling", "looking at camera",
    "looking at the camera", "eyes",
)
PARTIAL_MARKERS = (
    "hand", "hands", "glove", "gloves", "gloved", "arm", "arms", "finger", "fingers", "legs", "feet",
    "from behind", "back view", "rear view", "silhouette", "silhouetted", "faceless", "face not visible",
    "face is not visible", "face obscured", "face hidden", "face covered", "unrecognizable", "anonymous",
    "blurred figure",
)
FACE_NEGATIONS = (
    "face not visible", "face is not visible", "face obscured", "face hidden", "face covered", "faceless",
)
PERSON_SUBJECT_WORDS = (
    "person", "people", "man", "men", "woman", "women", "worker", "workers", "engineer", "technician",
    "operator", "electrician", "builder", "welder", "mechanic",
)
NON_HUMAN_PHRASES = (
    "hand tool", "hand tools", "hand rail", "hand rails", "hand truck", "hand wheel", "robotic arm",
    "robot arm", "crane arm", "mechanical arm", "swing arm",
)
CHILD_WORDS = (
    "child", "children", "child's", "children's", "kid", "kids", "baby", "babies", "toddler", "toddlers",
    "infant", "infants", "boy", "boys", "girl", "girls", "schoolboy", "schoolgirl", "teenager", "teenagers", "teen",
)
DOCUMENT_TERMS = (
    "passport", "identity document", "identity card", "id card", "national id", "driver's license",
    "driver's licence", "driving license", "driving licence", "residence permit", "residential registration",
    "propiska", "birth certificate", "marriage certificate", "bank card", "credit card", "debit card",
    "social security card", "personal details", "personal data",
)
LEGAL_CLAIM_PATTERNS = (
    r"certified", r"certification", r"compliant", r"compliance", r"approved", r"patented", r"patent",
    r"trademark(?:ed)?", r"licensed", r"official", r"guaranteed", r"guarantee", r"warranty",
    r"iso\s?\d{3,5}", r"ul listed", r"ce marked", r"meets\b.{0,40}?\bstandards?",
)
EMAIL_PATTERN = r"\S+@\S+\.\S+"
PHONE_PATTERN = r"\+?\d[\d\s()\-]{8,}\d"
CODE_PATTERN = r"[A-ZА-ЯЁ]{1,4}-[A-ZА-ЯЁ0-9]{1,4}"
TITLE_WORD_PATTERN = r"^[A-ZА-ЯЁ][a-zа-яё]+(?:-[A-ZА-ЯЁ]?[a-zа-яё]+)*$"

# --- rights and categories -------------------------------------------------------------------
DOMINANCE_WORDS = ("logo", "logotype", "brand", "branding", "signage", "trademark")
ATTESTATION_KINDS = ("not_identifiable", "release_on_file", "none")
LIFTING_ATTESTATIONS = ("not_identifiable", "release_on_file")
# (group, name on adobe, name on shutterstock, terms)
CATEGORY_RULES = (
    ("industry", "Industry", "Industrial", (
        "industrial", "industry", "factory", "manufacturing", "machinery", "machine", "electrical", "wiring",
        "wire", "wires", "cable", "cables", "elevator", "lift", "shaft", "pipe", "pipes", "valve", "mechanism",
        "equipment", "construction", "power supply", "control panel", "junction box", "terminal block",
        "infrastructure", "engineering", "maintenance",
    )),
    ("buildings", "Buildings and architecture", "Buildings/Landmarks", (
        "building", "architecture", "architectural", "facade", "interior", "staircase", "room", "wall", "house",
    )),
    ("technology", "Technology", "Technology", (
        "computer", "electronics", "electronic", "circuit", "server", "device", "smartphone", "technology",
    )),
    ("transport", "Transport", "Transportation", (
        "car", "truck", "train", "vehicle", "road", "highway", "transport", "transportation",
    )),
    ("leisure", "Hobbies and leisure", "Parks/Outdoor", (
        "playground", "park", "recreation", "recreational", "garden",
    )),
    ("nature", "Plants and flowers", "Nature", (
        "tree", "trees", "forest", "plant", "plants", "flower", "flowers", "nature",
    )),
    ("textures", "Graphic resources", "Backgrounds/Textures", (
        "texture", "background", "pattern", "surface",
    )),
)
SECOND_CATEGORY_MIN_SCORE = 2
SECOND_CATEGORY_MIN_SHARE = 0.25

# --- platforms -------------------------------------------------------------------------------
MIB = 1024 * 1024
PLATFORM_PROFILES = (
    {"platform": "adobe", "version": "adobe-2026-09", "min_mp": 4.0, "max_mp": 100.0, "max_file_size": 45 * MIB,
     "formats": ("JPEG",), "text_field": "title", "text_max": 200, "text_recommended": 70, "text_min_words": None,
     "keywords_min": 1, "keywords_max": 49, "category_required": False, "max_categories": 1, "color_space": "srgb"},
    {"platform": "shutterstock", "version": "shutterstock-2026-09", "min_mp": 4.0, "max_mp": None,
     "max_file_size": 50 * MIB, "formats": ("JPEG", "TIFF"), "text_field": "description", "text_max": 2048,
     "text_recommended": None, "text_min_words": 5, "keywords_min": 7, "keywords_max": 50,
     "category_required": True, "max_categories": 2, "color_space": "srgb"},
)
EXPORT_PROFILES = (
    {"platform": "adobe", "version": "adobe-2026-09", "min_mp": 4.0, "max_mp": 100.0, "max_file_size": 45 * MIB,
     "text_field": "title", "title_max": 200, "title_recommended": 70, "keywords_min": 7, "keywords_max": 49,
     "filename_max": 30, "text_min_words": None, "comma_warning": True, "long_code": "TITLE_LONG",
     "whitelist": ("segment:APP1:XMP", "segment:APP2:ICC", "xmp:dc:subject", "xmp:dc:title")},
    {"platform": "shutterstock", "version": "shutterstock-2026-09", "min_mp": 4.0, "max_mp": None,
     "max_file_size": 50 * MIB, "text_field": "description", "title_max": 2048, "title_recommended": 150,
     "keywords_min": 7, "keywords_max": 50, "filename_max": 30, "text_min_words": 5, "comma_warning": False,
     "long_code": "DESCRIPTION_LONG_FOR_RECOMMENDATION",
     "whitelist": ("segment:APP1:XMP", "segment:APP2:ICC", "xmp:dc:description", "xmp:dc:subject")},
)
PLATFORMS = ("adobe", "shutterstock")
EXPORT_EXTENSION = ".jpg"
# Cyrillic letter -> Latin spelling used in file names
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
FILENAME_STOP_WORDS = (
    "photo", "photos", "image", "images", "picture", "pic", "stock", "jpg", "jpeg",
    "a", "an", "the", "of", "with", "and", "in", "on", "at", "for", "to", "by", "from",
)
# The catalogue product's own name is forbidden too; callers pass it (it is not a property of the rules).
FILENAME_FORBIDDEN = (
    "img", "pxl", "dsc", "dscn", "dcim", "mvimg", "mv", "topaz", "photoshop", "ps", "lightroom", "lr",
    "gigapixel", "ai", "edited", "edit", "final", "copy", "standard",
)
FILENAME_FORBIDDEN_PATTERN = r"^(v[0-9]+|final[0-9]+|[0-9]+)$"
BATCH_FOLDER_PATTERN = r"^(\d{3,})_\d{4}-\d{2}-\d{2}$"

# --- creative review -------------------------------------------------------------------------
COMPOSITION_POINTS = {"good": 35, "acceptable": 20, "weak": 5}
DEMAND_POINTS = {"high": 30, "medium": 18, "low": 5}
UNIQUENESS_POINTS = {"high": 25, "medium": 15, "low": 5}
USE_CASE_POINTS = 2
USE_CASE_MAX_POINTS = 10
POTENTIAL_HIGH_FROM = 70
POTENTIAL_MEDIUM_FROM = 40
ADVICE_NOTES = {"attention": "ADVISOR_ATTENTION", "skip_suggested": "ADVISOR_SKIP_SUGGESTED"}
DEFAULT_CREATIVE_PROFILE = "industrial_stock"
ROUTE_TERMS = {
    "industrial_stock": (
        "industrial", "industry", "factory", "machinery", "machine", "equipment", "electrical", "wiring", "wire",
        "cable", "cables", "elevator", "lift", "shaft", "construction", "concrete", "metal", "steel", "pipe",
        "valve", "mechanism", "tool", "drill", "hammer", "installation", "engineering", "panel", "circuit",
        "breaker", "motor", "demolition", "bolt", "rust", "asphalt", "texture", "surface", "duct", "ductwork",
    ),
    "architecture_stock": (
        "building", "buildings", "architecture", "architectural", "facade", "skyline", "cityscape", "city",
        "urban", "rooftop", "roof", "residential", "apartment", "street", "tower", "bridge", "district",
        "neighborhood", "housing",
    ),
    "nature_stock": (
        "landscape", "mountain", "mountains", "forest", "tree", "trees", "sea", "ocean", "beach", "lake", "river",
        "sky", "sunset", "sunrise", "snow", "nature", "natural", "park", "garden", "flower", "flowers", "plant",
        "plants", "hills", "valley", "rock", "rocks", "field", "meadow",
    ),
}

# --- rights of actors ------------------------------------------------------------------------
ACTOR_PATTERN = r"^(human|agent:[a-z0-9_.-]+|workflow:[a-z0-9_.-]+)$"
REVIEW_OPERATIONS = ("metadata.approve", "metadata.reject")
CONTENT_OPERATIONS = ("metadata.edit", "metadata.rebuild", "metadata.build")
WORKFLOW_ALLOWED = (
    "asset.get", "asset.list", "asset.history", "metadata.get", "review.queue", "operations.list", "incoming.list",
    "asset.process_file", "asset.process", "metadata.build", "metadata.gate", "normalize.evaluate", "normalize.run",
    "normalize.get", "enhancement.assess", "enhancement.advise", "enhancement.get", "creative.review", "creative.get",
    "readiness.evaluate", "readiness.get", "publication.evaluate", "publication.get", "notification.record",
)
WORKFLOW_NO_FORCE = ("asset.process", "metadata.build")
AGENT_FORBIDDEN = ("notification.record", "export.prepare", "export.get", "asset.attest_people", "export.collect")

# --- limits that are features ----------------------------------------------------------------
RECENT_EVENTS = 15
SUMMARY_CHARS = 120
RETRY_MAX_FAILED = 3
RETRY_MAX_PER_RUN = 5
DIGEST_PROBLEM_ASSETS = 10
NOTICE_TITLE_CHARS = 200
NOTICE_MAX_ITEMS = 200
REDACTED = "[redacted]"
REDACT_MIN_LENGTH = 3
