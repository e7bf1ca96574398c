"""Fixed values that must equal the behaviour being reproduced.

Everything here is data: selector lists, keyword lists with their points,
marks and templates. They are listed plainly, in their natural order, because
order is part of the semantics (first selector wins, first keyword class wins).
"""

# ---- FIXED VALUES: main content area selectors, tried in order (N3) ----
MAIN_AREA_SELECTORS = [
    "main", "article", ".content", ".main-content", ".article-content", ".post-content",
    ".entry-content", "#content", "#main", "#article", ".container .content", ".wrapper .content",
]

# ---- FIXED VALUES: article / goods area class selectors, in order (I7) ----
ARTICLE_AREA_CLASSES = [
    "goods", "product", "item", "merchandise",
    "gallery", "photos", "images",
    "character", "anime", "collaboration",
    "popup", "store", "campaign",
    "novelty", "special", "limited",
    "featured", "highlight",
]

# ---- FIXED VALUES: meta image tags, in order (I9) ----
META_IMAGE_TAGS = [
    ("property", "og:image"),
    ("name", "twitter:image"),
    ("name", "twitter:image:src"),
]

# ---- FIXED VALUES: image sources tried in order (I1) ----
IMAGE_SRC_ATTRS = ["src", "data-src", "data-original", "data-lazy-src", "data-lazy", "data-srcset", "srcset"]

# ---- FIXED VALUES: image URL validity (I3) ----
INVALID_URL_PARTS = [
    "data:image", "placeholder", "loading", "spinner", ".svg", "1x1", "pixel", "spacer",
    "blank", "transparent", "favicon", "noimage", "analytics", "tracking",
]
INVALID_FILE_PARTS = ["btn_", "spacer_", "blank_"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp"]
IMAGE_PATH_WORDS = ["image", "img", "photo", "picture", "gallery", "media"]
MIN_IMAGE_URL_LENGTH = 10

# ---- FIXED VALUES: image importance (I4) ----
ALT_WORDS = [
    "goods", "product", "item", "merchandise",
    "character", "anime", "collaboration", "collab",
    "popup", "store", "campaign", "event",
    "novelty", "special", "limited", "exclusive",
    "new", "latest", "featured", "main",
]
ALT_POINTS = 3
CLASS_GOOD_WORDS = [
    "main", "hero", "featured", "primary",
    "goods", "product", "item", "gallery",
    "character", "anime", "artwork",
    "campaign", "special", "highlight",
]
CLASS_GOOD_POINTS = 2
CLASS_BAD_WORDS = [
    "thumb", "thumbnail", "small", "mini",
    "icon", "logo", "brand", "header", "footer",
    "nav", "menu", "ad", "banner", "sidebar",
]
CLASS_BAD_POINTS = -3
PARENT_WORDS = [
    "gallery", "photos", "images", "slideshow",
    "goods", "products", "items", "merchandise",
    "main", "content", "article", "featured",
    "hero", "banner", "highlight",
]
PARENT_POINTS = 2
# size term: (w >= 400 or h >= 300) +2; (w >= 200 or h >= 150) +1; (w < 100 and h < 100) -2

# ---- FIXED VALUES: image quality (I5) ----
QUALITY_BASE = 10
QUALITY_FLOOR = 5
QUALITY_WORDS = [
    ("large", 4), ("big", 3), ("full", 4), ("original", 5), ("high", 3), ("main", 4),
    ("hero", 5), ("featured", 4), ("gallery", 3), ("photo", 3), ("image", 2), ("picture", 2),
    ("visual", 2), ("artwork", 4), ("character", 4), ("anime", 4), ("goods", 4), ("product", 4),
    ("item", 3), ("merchandise", 3), ("collaboration", 3), ("event", 3), ("popup", 4), ("store", 2),
    ("campaign", 3), ("special", 3), ("limited", 3), ("exclusive", 3), ("new", 2), ("latest", 2),
    ("banner", 2), ("logo", 1), ("icon", 1),
]
QUALITY_LOW_WORDS = [
    ("thumb", -2), ("thumbnail", -2), ("small", -1), ("mini", -1), ("tiny", -2), ("pixel", -5),
    ("tracking", -5), ("spacer", -5), ("blank", -5), ("placeholder", -3), ("default", -1),
]
QUALITY_HOST_WORDS = ["cdn", "media", "assets", "static", "images"]
# deep path: more than 5 '/'-parts +2; host words +2; >= 3 digits in file name +1;
# url longer than 100 +1; first NxM (3-4 digits each): >= 800 or >= 600 +3, >= 400 or >= 300 +1;
# first wN and first hN (3-4 digits): >= 800 +3, >= 400 +1.

# ---- FIXED VALUES: caps per zone and final cap (I13, I14, I15) ----
ZONE_CAPS = {1: 5, 2: 3, 3: 3, 4: 2, 5: 1}
FINAL_IMAGE_CAP = 10
META_FALLBACK_BELOW = 3
BACKGROUND_FALLBACK_BELOW = 2
RENDER_BELOW = 3

# ---- FIXED VALUES: text area (N4) and removed tags (P3) ----
TEXT_AREA_PATTERN = "content|main|article"
REMOVED_TEXT_TAGS = ["script", "style", "nav", "header", "footer"]
DESCRIPTION_CHARS = 200
DESCRIPTION_SUFFIX = "..."

# ---- FIXED VALUES: content type keywords, first class wins (C1) ----
CONTENT_TYPES = [
    ("cafe", ["カフェ", "cafe", "ドリンク", "メニュー"]),
    ("novel_game", ["ノベルゲーム", "ゲーム", "game"]),
    ("anime", ["アニメ", "anime"]),
]
DEFAULT_CONTENT_TYPE = "general"

# ---- FIXED VALUES: asset admission (I16) ----
ASSET_TYPE_WORDS = ["image/", "jpeg", "jpg", "png", "gif", "webp"]
ASSET_MAX_BYTES = 15 * 1024 * 1024
ASSET_SUFFIXES = [("png", ".png"), ("gif", ".gif"), ("webp", ".webp")]
ASSET_DEFAULT_SUFFIX = ".jpg"
ASSET_MIME = [(".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".png", "image/png"),
              (".gif", "image/gif"), (".webp", "image/webp")]

# ---- FIXED VALUES: document blocks (D1-D8) ----
BLOCK_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "div"]
BLOCK_MIN_CHARS = 3
BLOCK_SKIP_CLASS_PARTS = ["ads", "advertisement", "hidden"]
PLACEHOLDER_MARKS = ["-適切な画像を挿入ー", "-適切な画像を挿入-", "適切な画像を挿入", "[画像", "IMAGE_PLACEHOLDER"]
PARAGRAPH_MIN_CHARS = 10  # p/div kept only when longer than this
IMAGE_FAILED_TEXT = "[画像: {url}]\n"
DOC_START_INDEX = 1
IMAGE_WIDTH_PT = 400
IMAGE_HEIGHT_PT = 300
LIST_MIN_CHARS = 5
LIST_BULLET = "• "
LIST_STYLES = [("h1", "HEADING_1"), ("h2", "HEADING_2"), ("h3", "HEADING_3"), ("h4", "HEADING_4"),
               ("h5", "HEADING_5"), ("h6", "HEADING_6"), ("p", "NORMAL_TEXT"), ("div", "NORMAL_TEXT"),
               ("span", "NORMAL_TEXT"), ("strong", "NORMAL_TEXT"), ("b", "NORMAL_TEXT"),
               ("em", "NORMAL_TEXT"), ("i", "NORMAL_TEXT")]

# ---- FIXED VALUES: image marks filled in order (D12) ----
FILL_MARK_PATTERNS = [
    r"\[single_photoswipe\].*?\[/single_photoswipe\]",
    r"-適切な画像を挿入ー",
    r"-適切な画像を挿入-",
    r"適切な画像を挿入",
    r"\[IMAGE_PLACEHOLDER_\p{Nd}+\]",
    r"\[.*?PLACEHOLDER.*?\]",
]

# ---- FIXED VALUES: folder / article key (D10) ----
KEY_STAMP_FORMAT = "yyyyMMdd_HHmm"
KEY_DROP_CHARS = '<>:"/\\|?*'
KEY_MAX_CHARS = 50

# ---- FIXED VALUES: info tables (H2-H4) ----
INFO_TABLE_CLASS = "event-info-table"
INFO_TABLE_HEADER = "\n【開催情報】\n"
INFO_SUMMARY_HEADER = "【開催情報】\n"
INFO_SUMMARY_KEYS = [
    ("official_site", "公式サイト"),
    ("location", "開催場所"),
    ("period", "開催期間"),
    ("access", "アクセス"),
    ("contact", "お問い合わせ"),
]

# ---- FIXED VALUES: tracking parameters for official links (A7) ----
UTM_PARAMS = ("?utm_source=collabo_cafe_dot_com&amp;utm_medium=collabo_cafe_dot_com"
              "&amp;utm_campaign=collabo_cafe_dot_com&amp;utm_id=collabo_cafe_dot_com")

# ---- FIXED VALUES: article assembly (A3-A5, R2, R7) ----
DEFAULT_CATEGORY = "POP UP"
ARTICLE_TITLE_PREFIX = "ポップアップストア記事 - "
GENERATED_AT = "2024-01-01T00:00:00Z"
SUCCESS_MESSAGE = "記事が正常に生成されました"
