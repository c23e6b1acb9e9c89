"""Constants, lists and patterns that results depend on, stated as plain text."""

# Audio suffixes a library scan keeps.
AUDIO_SUFFIXES = ("flac", "wav", "ogg", "opus", "mp3", "m4a")

# Number of leading and trailing bytes that go into a content id.
HEAD_TAIL_BYTES = 1 << 20

# Sample rates, window length, hop and pooled layers.
TARGET_SR = 24_000
TEACHER_SR = 48_000
WINDOW_SECONDS = 5.0
WINDOW_SAMPLES = 120_000
HOP_SAMPLES = 60_000
POOL_LAYERS = (5, 6, 7, 8)
MIN_CLIP_SAMPLES = 1024
MIN_AUDIO_BYTES = 50_000

# Log-mel front end.
MEL_N_FFT = 1024
MEL_HOP = 480
MEL_BANDS = 96
MEL_F_MIN = 20.0
MEL_F_MAX = 12_000.0
MEL_AMIN = 1e-5

# Dataset subsets, each with the ones it contains.
SUBSET_LEVELS = {
    "small": ("small",),
    "medium": ("small", "medium"),
    "large": ("small", "medium", "large"),
}

# K lists of the reports and the quality gates (metric, operator, threshold).
EVAL_KS = (1, 5, 10, 20)
OVERLAP_KS = (5, 10, 20)
QUALITY_GATES = (
    ("recall_at_10", ">=", 0.65),
    ("cosine_mean_fp32", ">=", 0.99999),
    ("cosine_mean_int8", ">=", 0.9995),
)

# The 50 tags of the standard MagnaTagATune benchmark subset.
BENCHMARK_TAGS = (
    "guitar", "classical", "slow", "techno", "strings", "drums", "electronic", "rock", "fast",
    "piano", "ambient", "beat", "violin", "vocal", "synth", "female", "indian", "opera", "male",
    "singing", "vocals", "no vocals", "harpsichord", "loud", "quiet", "flute", "woman",
    "male vocal", "no vocal", "pop", "soft", "sitar", "solo", "man", "classic", "choir", "voice",
    "new age", "dance", "male voice", "female vocal", "beats", "harp", "cello", "no voice",
    "weird", "country", "metal", "female voice", "choral",
)

# Title noise, tried in this order at every position (regex text).
TITLE_NOISE = (
    r"\([^()]*\b(?:official|music\s*video|mv|m/v|lyric\s*video|lyrics?|audio|visualizer|remaster(?:ed)?|hd|hq)\b[^()]*\)",
    r"\[[^\[\]]*\b(?:official|music\s*video|mv|m/v|lyric\s*video|lyrics?|audio|visualizer|remaster(?:ed)?|hd|hq)\b[^\[\]]*\]",
    r"\[\s*extended\s*(?:version|mix|cut|edit)?\s*\]",
    r"\(\s*extended\s*(?:version|mix|cut|edit)?\s*\)",
    r"\[\s*\d+\s*(?:hours?|h|minutes?|mins?|m)\s*(?:loop|version|mix)?\s*\]",
    r"\(\s*\d+\s*(?:hours?|h|minutes?|mins?|m)\s*(?:loop|version|mix)?\s*\)",
    r"\[\s*loop(?:ed)?\s*\]",
    r"\(\s*loop(?:ed)?\s*\)",
    r"\(\s*(?:feat|ft|featuring|with)\b\.?[^)]*\)",
    r"\[\s*(?:feat|ft|featuring|with)\b\.?[^\]]*\]",
    r"\s+(?:feat|ft|featuring|with)\b\.?[^()\[\]]*$",
    r"\s+-\s*topic\s*$",
    r"\s*\|\s*[^|]*$",
)

# Where a video id sits in a URL, and the year and date shapes in descriptions.
VIDEO_ID = r"(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})"
YEAR = r"(?:℗|©|Released on:|\b)([0-9]{4})(?:-[0-9]{2}-[0-9]{2})?"
RELEASED_ON = r"Released on:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
OFFICIAL_SUFFIX = r"\s*\(?official (audio|video)\)?\s*"
HD_SUFFIX = r"\s+HD$"

# Genre rules (priority, needles, label, needle of the exception, its label).
GENRE_RULES = (
    (1, ("ost", "soundtrack", "skyrim", "spider-verse", "game soundtrack"), "Soundtrack", None, None),
    (2, ("phonk", "montagem", "funk"), "Phonk", "montagem", "Brazilian Funk"),
    (3, ("anime", "hajimemashita", "miku"), "Electronic", "hajimemashita", "Anime"),
    (4, ("rock", "guns n", "radiohead", "тигре", "княzz", "электрослабость"), "Rock", None, None),
    (5, ("dance", "guetta", "inna", "bellini", "nightcrawlers"), "Dance", None, None),
    (6, ("rap", "hip-hop", "metro boomin", "bruno mars", "yeat", "sean paul"), "Hip-Hop/Rap", None, None),
)
DEFAULT_GENRE = "Pop"

# Duration limits in seconds and the linkage acceptance score.
MIN_DURATION = 60.0
MAX_DURATION = 600.0
LINK_MIN_SCORE = 60.0

# Texts of the source note.
NOTE_DEFAULT = "Auto-generated by YouTube."
NOTE_INFERRED = "Source: YouTube Music. Metadata inferred where needed."
NOTE_PROVIDER = "Provided to YouTube by"
