"""Lookup tables and constants whose values define the results.

Each table is stated once, in its natural order; the order is the priority where
an operator takes the first match.
"""

from __future__ import annotations

# --- media formats ---------------------------------------------------------------------------------------------------
STATIC_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif", ".ico", ".hdr", ".ppm", ".pgm", ".pbm", ".jp2", ".j2k", ".j2c", ".jpx", ".tga",
    ".icb", ".vda", ".vst", ".pcx", ".sgi", ".bw", ".spi", ".dds", ".fits", ".fit", ".xbm", ".icns", ".cur", ".im", ".msp", ".fpx", ".psp", ".blp",
)
ANIMATED_EXTENSIONS = (
    ".gif", ".apng", ".mng", ".fli", ".flc", ".mp4", ".m4v", ".m2v", ".webm", ".mkv", ".avi", ".mov", ".flv", ".mpg", ".mpeg", ".mpe", ".mpv",
    ".3gp", ".3gpp", ".ogv", ".wmv", ".asf", ".ts", ".m2ts", ".mts", ".vob", ".rm", ".rmvb", ".ogm",
)
PLUGIN_EXTENSIONS = (
    ".avif", ".heic", ".heif", ".jxl", ".qoi", ".psd", ".exr", ".svg", ".pdf", ".dng", ".cr2", ".cr3", ".nef", ".arw", ".raf", ".orf", ".rw2",
    ".pef", ".nrw", ".srw", ".x3f",
)
#: Extensions that are moving pictures but no video.
FRAME_EXTENSIONS = (".gif", ".apng", ".mng", ".fli", ".flc")
#: Moving pictures for frame sampling; webp counts as one there.
SAMPLED_ANIMATIONS = (".gif", ".apng", ".webp", ".mng", ".fli", ".flc")
SKIPPED_NAMES = ("README.md", "LICENSE", "requirements.txt", "run.sh", ".gitignore")
#: (offset, bytes, format), the first match wins.
MAGIC = (
    (0, b"\xff\xd8\xff", "JPEG"), (0, b"\x89PNG\r\n\x1a\n", "PNG"), (0, b"GIF87a", "GIF"), (0, b"GIF89a", "GIF"), (0, b"BM", "BMP"),
    (0, b"II*\x00", "TIFF-LE"), (0, b"MM\x00*", "TIFF-BE"), (0, b"v/1\x01", "EXR"), (0, b"8BPS", "PSD"), (0, b"8BPB", "PSB"),
    (0, b"DDS ", "DDS"), (0, b"qoif", "QOI"), (0, b"P1", "PBM-ASCII"), (0, b"P2", "PGM-ASCII"), (0, b"P3", "PPM-ASCII"),
    (0, b"P4", "PBM"), (0, b"P5", "PGM"), (0, b"P6", "PPM"), (0, b"\x8aMNG\r\n\x1a\n", "MNG"), (0, b"\x8bMNG\r\n\x1a\n", "MNG"),
    (0, b"\x8bJNG\r\n\x1a\n", "JNG"), (4, b"\x11\xaf", "FLI"), (4, b"\x12\xaf", "FLC"), (8, b"VP8 ", "WEBP"), (8, b"VP8L", "WEBP"),
    (8, b"VP8X", "WEBP"), (4, b"ftypheic", "HEIC"), (4, b"ftypheix", "HEIC"), (4, b"ftypheim", "HEIC"),
    (4, b"ftypheis", "HEIC"), (4, b"ftypmif1", "HEIF"), (4, b"ftypmsf1", "HEIF"), (4, b"ftypavif", "AVIF"),
    (4, b"ftypavis", "AVIF"), (4, b"ftypjxl", "JPEG-XL"), (4, b"ftypqt  ", "MOV"), (4, b"ftypmp42", "MP4"),
    (4, b"ftypmp41", "MP4"), (4, b"ftypisom", "MP4"), (4, b"ftypM4V ", "M4V"), (4, b"ftypM4A ", "M4A"),
    (4, b"ftypdash", "DASH"), (0, b"\x1aE\xdf\xa3", "WEBM/MKV"), (8, b"AVI ", "AVI"), (0, b"FLV\x01", "FLV"), (0, b"FWS", "SWF"),
    (0, b"CWS", "SWF"), (0, b"\x00\x00\x01\xba", "MPEG-PS"), (0, b"\x00\x00\x01\xb3", "MPEG-Video"), (0, b"OggS", "OGG"), (0, b"G", "MPEG-TS"),
    (0, b"\x00\x00\x00\x0cjP  ", "JPEG-2000"), (0, b"\x00\x00\x00\x0cjp2 ", "JPEG-2000"), (0, b"\xffO\xffQ", "JPEG-2000"), (4, b"JXL ", "JPEG-XL"),
    (0, b"\xff\n", "JPEG-XL"), (4, b"ftyp", "MP4"),
)
RIFF_KINDS = ((b"WEBP", "WEBP"), (b"AVI ", "AVI"), (b"WAVE", "WAV"))

# --- duplicates ------------------------------------------------------------------------------------------------------
#: (name, most bits of dh, most bits of ph, least cosine), strictest first.
TIERS = (("reencode", 2, 2, 0.97), ("resize", 8, 10, 0.85), ("similar", 14, 16, 0.75))
MAJORITY = 0.5

# --- colours ---------------------------------------------------------------------------------------------------------
HUES = ((15, "Red"), (40, "Orange"), (65, "Yellow"), (150, "Green"), (200, "Teal-Cyan"), (260, "Blue"), (300, "Purple"), (345, "Pink-Magenta"), (360, "Red"))
COLOURS = ("Red", "Orange", "Yellow", "Green", "Teal-Cyan", "Blue", "Purple", "Pink-Magenta", "Black", "White", "Gray")
COLOUR_TAGS = {
    "Red": "red", "Orange": "orange", "Yellow": "yellow", "Green": "green", "Teal-Cyan": "teal", "Blue": "blue", "Purple": "purple",
    "Pink-Magenta": "pink", "Black": "dark", "White": "light", "Gray": "grayscale",
}
COLOUR_PHRASES = {
    "Red": "warm red tones", "Orange": "warm orange tones", "Yellow": "warm yellow tones", "Green": "lush green tones",
    "Teal-Cyan": "cool teal hues", "Blue": "cool blue tones", "Purple": "rich purple tones", "Pink-Magenta": "vibrant pink hues",
    "Black": "deep blacks", "White": "clean whites", "Gray": "neutral grays",
}
THEMES = {
    "catppuccin": {"Pink-Magenta": 0.20, "Purple": 0.15, "Blue": 0.10, "Gray": 0.20, "Black": 0.15, "White": 0.10, "Orange": 0.05, "Teal-Cyan": 0.05},
    "dracula": {"Black": 0.45, "Purple": 0.20, "Pink-Magenta": 0.10, "Blue": 0.10, "Teal-Cyan": 0.05, "Green": 0.05, "Gray": 0.05},
    "tokyonight": {"Blue": 0.25, "Purple": 0.20, "Black": 0.20, "Teal-Cyan": 0.10, "Pink-Magenta": 0.05, "Gray": 0.10, "White": 0.05, "Green": 0.05},
    "nord": {"Blue": 0.20, "Teal-Cyan": 0.15, "Gray": 0.35, "White": 0.15, "Black": 0.05, "Green": 0.05, "Purple": 0.05},
    "gruvbox": {"Orange": 0.30, "Yellow": 0.20, "Gray": 0.20, "Black": 0.10, "White": 0.10, "Red": 0.05, "Green": 0.05},
    "everforest": {"Green": 0.45, "Gray": 0.20, "Yellow": 0.10, "White": 0.10, "Black": 0.05, "Orange": 0.05, "Teal-Cyan": 0.05},
    "monochrome": {"Black": 0.40, "White": 0.30, "Gray": 0.30},
    "neon": {"Pink-Magenta": 0.30, "Purple": 0.25, "Teal-Cyan": 0.15, "Blue": 0.15, "Black": 0.10, "Green": 0.05},
}
ASPECT_BUCKETS = (
    (9, 21, "ultrawide"), (9, 16, "wide"), (3, 4, "portrait"), (1, 1, "square"), (4, 3, "standard"), (16, 10, "wide"), (16, 9, "widescreen"), (21, 9, "ultrawide"),
)

# --- tags ------------------------------------------------------------------------------------------------------------
#: (score column, tag, threshold)
STYLE_RULES = (
    ("anime_score", "anime", 0.25), ("anime_score", "illustration", 0.40), ("anime_score", "cartoon", 0.40), ("anime_score", "digital-art", 0.45),
    ("cyberpunk_score", "cyberpunk", 0.30), ("cyberpunk_score", "sci-fi", 0.35), ("cyberpunk_score", "neon", 0.40), ("cyberpunk_score", "dark", 0.45),
    ("cyberpunk_score", "city", 0.45), ("space_score", "space", 0.40), ("space_score", "galaxy", 0.40), ("space_score", "cosmos", 0.45),
    ("space_score", "dark", 0.45), ("nature_score", "nature", 0.30), ("nature_score", "outdoor", 0.35), ("nature_score", "landscape", 0.40),
    ("neon_score", "neon", 0.30), ("neon_score", "vibrant", 0.40), ("pastel_score", "pastel", 0.30), ("pastel_score", "light", 0.35),
    ("sepia_score", "retro", 0.25), ("sepia_score", "sepia", 0.30), ("vintage_score", "retro", 0.25), ("vintage_score", "vintage", 0.30),
    ("vw_score", "vaporwave", 0.20), ("vw_score", "retro", 0.30),
)
EXCLUSIVE = (
    ("minimalist", "detailed"), ("minimalist", "complex"), ("monochrome", "vibrant"), ("monochrome", "colorful"), ("grayscale", "vibrant"),
    ("grayscale", "colorful"), ("black-and-white", "colorful"), ("photo", "illustration"), ("photo", "anime"), ("photo", "cartoon"),
    ("photograph", "anime"), ("light", "dark"), ("warm", "cool"), ("sunset", "night"), ("day", "night"), ("summer", "winter"),
)
#: (tag, related tag, weight); tags listed twice in the source keep their later entry.
COOCCURRENCE = (
    ("cyberpunk", "neon", 0.8), ("cyberpunk", "sci-fi", 0.7), ("cyberpunk", "dark", 0.6), ("cyberpunk", "city", 0.6), ("cyberpunk", "tech", 0.3),
    ("space", "galaxy", 0.8), ("space", "stars", 0.6), ("space", "dark", 0.5), ("space", "cosmos", 0.7), ("nature", "landscape", 0.7),
    ("nature", "outdoor", 0.7), ("nature", "forest", 0.5), ("nature", "mountain", 0.4), ("forest", "nature", 0.9), ("forest", "green", 0.7),
    ("forest", "trees", 0.7), ("forest", "outdoor", 0.7), ("ocean", "blue", 0.8), ("ocean", "water", 0.8), ("ocean", "nature", 0.6),
    ("ocean", "waves", 0.4), ("city", "urban", 0.7), ("city", "skyline", 0.5), ("city", "night", 0.4), ("sunset", "warm", 0.7),
    ("sunset", "orange", 0.7), ("sunset", "sky", 0.6), ("portrait", "person", 0.7), ("portrait", "face", 0.6), ("portrait", "human", 0.5),
    ("pixel-art", "retro", 0.6), ("pixel-art", "8-bit", 0.5), ("pixel-art", "game", 0.4), ("vintage", "retro", 0.8), ("vintage", "sepia", 0.5),
    ("vintage", "old", 0.4), ("minimalist", "simple", 0.7), ("minimalist", "clean", 0.5), ("minimalist", "monochrome", 0.4), ("neon", "vibrant", 0.7),
    ("neon", "dark", 0.5), ("neon", "glow", 0.5), ("anime", "manga", 0.5), ("anime", "character", 0.4), ("illustration", "drawing", 0.6),
    ("illustration", "art", 0.5), ("illustration", "painting", 0.4), ("sci-fi", "futuristic", 0.7), ("sci-fi", "tech", 0.5), ("sci-fi", "space", 0.4),
)
CURATED_TAGS = (
    "anime", "manga", "cartoon", "3d-render", "sketch", "watercolor", "oil-painting", "drawing", "pixel-art", "voxel", "low-poly", "vector",
    "realistic", "photograph", "polaroid", "screenshot", "poster", "wallpaper", "woman", "man", "kid", "boy", "girl", "couple", "warrior", "wizard",
    "knight", "samurai", "cyborg", "dragon", "phoenix", "wolf", "fox", "tiger", "lion", "bear", "rabbit", "deer", "eagle", "raven", "robot", "mech",
    "spaceship", "car", "motorcycle", "sword", "shield", "castle", "tower", "spaceship", "fantasy", "sci-fi", "cyberpunk", "vaporwave", "steampunk",
    "horror", "romance", "sports", "mecha", "space-opera", "calm", "dramatic", "peaceful", "mysterious", "epic", "cute", "dark", "bright",
    "energetic", "centered", "closeup", "wide-shot", "monochrome", "pastel", "neon", "vintage",
)
GENERIC_TAGS = (
    "abstract", "detailed", "simple", "light", "dark", "warm", "cool", "vibrant", "colorful", "beautiful", "artistic", "creative", "illustration",
    "digital-art", "painting", "art", "drawing", "wallpaper", "background", "image", "photo", "photograph", "high-quality", "4k", "hd", "landscape",
    "portrait", "portrait-orientation", "landscape-orientation", "vertical", "horizontal", "wide", "sky", "clouds", "building", "city", "urban",
    "nature", "forest", "mountain", "tree", "flowers", "animal", "person", "people", "human", "figure", "face", "head", "body", "woman", "man",
    "couple", "vintage", "retro", "minimalist", "pastel", "neon", "monochrome",
)
TAG_BUDGET, TAG_PICKS = 15, 8

# --- prompts ---------------------------------------------------------------------------------------------------------
#: (column, threshold, short phrase, long phrase), the first match wins.
STYLE_PHRASES = (
    ("anime_score", 0.30, "anime illustration", "stylised anime artwork"), ("anime_score", 0.50, "vibrant anime art", "detailed anime illustration"),
    ("cyberpunk_score", 0.30, "cyberpunk cityscape", "neon-lit sci-fi scene"), ("space_score", 0.35, "deep space vista", "cosmic galaxy scene"),
    ("nature_score", 0.30, "natural landscape", "outdoor nature scene"), ("neon_score", 0.30, "neon-glow aesthetic", "vivid neon colour palette"),
    ("pastel_score", 0.30, "soft pastel palette", "gentle pastel hues"), ("vw_score", 0.20, "vaporwave aesthetic", "retro vaporwave style"),
    ("sepia_score", 0.25, "vintage sepia tone", "aged sepia photograph"), ("vintage_score", 0.25, "vintage photograph look", "antique film grain"),
)
#: (column, threshold, phrase), all matches in order; a missing value counts as 0.
CONTENT_PHRASES = (
    ("skin_fraction", 0.15, "featuring a person"), ("skin_fraction", 0.30, "portrait of a person"), ("subject_area_ratio", 0.6, "with a central subject"),
    ("subject_area_ratio", 0.2, "minimalist composition"), ("centeredness", 0.75, "centred composition"), ("overall_symmetry", 0.7, "bilateral symmetry"),
    ("periodicity_score", 0.6, "repeating pattern"), ("is_periodic", 0.5, "repeating pattern"), ("is_tiled", 0.5, "tiled pattern"),
    ("unique_colors", 24, "limited colour palette"), ("texture_entropy", 4.7, "highly detailed"), ("texture_entropy", 2.8, "minimal texture"),
    ("aesthetic", 0.7, "high aesthetic quality"), ("sharpness", 400, "sharp high-resolution detail"),
)

# --- scores ----------------------------------------------------------------------------------------------------------
SIGNAL_WEIGHTS = {
    "tags": 0.10, "palette": 0.10, "style": 0.08, "content": 0.05, "theme": 0.07, "composition": 0.05, "quality": 0.03, "pattern": 0.04,
    "size": 0.03, "prompt": 0.08, "clip": 0.25, "clip_nsfw": 0.05, "fingerprint": 0.20,
}
#: Weights of fingerprint features that differ from 1.
FEATURE_WEIGHTS = {
    "colorfulness": 1.5, "edge_density": 1.5, "texture_entropy": 1.5, "radial_std": 0.5, "anime_score": 2.0, "cyberpunk_score": 2.0, "space_score": 2.0,
    "nature_score": 2.0, "neon_score": 1.8, "pastel_score": 1.8, "vw_score": 1.5, "sepia_score": 1.2, "vintage_score": 1.2, "noise_estimate": 0.5,
    "bris_quality_score": 0.8, "diagonal_strength": 0.8, "depth_gradient": 0.8, "subject_area_ratio": 1.5, "periodicity_score": 1.2,
    "texture_complexity": 1.2, "local_variance": 0.8, "entropy": 0.8, "h_symmetry": 0.6, "v_symmetry": 0.6, "point_symmetry": 0.6,
    "main_diagonal_symmetry": 0.5, "anti_diagonal_symmetry": 0.5, "overall_symmetry": 1.5, "skin_fraction": 1.5, "unique_colors": 1.2,
    "minecraft_score": 1.5, "pixel_art_score": 1.5, "minimalist_score": 1.5, "portrait_score": 1.2, "nsfw_score": 1.5, "gradient_score": 0.8,
    "theme_catppuccin_score": 1.5, "theme_dracula_score": 1.5, "theme_tokyonight_score": 1.5, "theme_nord_score": 1.5, "theme_gruvbox_score": 1.5,
    "theme_everforest_score": 1.5, "theme_monochrome_score": 1.5, "theme_neon_score": 1.5,
}
#: Range of each feature of the small models.
FEATURE_RANGES = {
    "anime_score": (0.0, 1.0), "cyberpunk_score": (0.0, 1.0), "space_score": (0.0, 1.0), "nature_score": (0.0, 1.0), "neon_score": (0.0, 1.0),
    "pastel_score": (0.0, 1.0), "vw_score": (0.0, 1.0), "sepia_score": (0.0, 1.0), "vintage_score": (0.0, 1.0), "skin_fraction": (0.0, 0.5),
    "sharpness": (0.0, 1500.0), "aesthetic": (0.0, 1.0), "centeredness": (0.0, 1.0), "overall_symmetry": (0.0, 1.0), "subject_area_ratio": (0.0, 1.0),
    "texture_entropy": (0.0, 6.0), "edge_density": (0.0, 0.5), "colorfulness": (0.0, 100.0), "unique_colors": (0.0, 256.0), "hsv_S_mean": (0.0, 100.0),
    "hsv_V_mean": (0.0, 100.0),
}
#: Labelled examples of the tag predictor: (category, features, tags).
EXAMPLES = (
    ("Anime", {"anime_score": 0.7, "colorfulness": 60, "edge_density": 0.20, "unique_colors": 200}, ("anime", "illustration", "digital-art")),
    ("Cyberpunk", {"cyberpunk_score": 0.7, "neon_score": 0.6, "space_score": 0.2, "skin_fraction": 0.05, "hsv_V_mean": 30, "colorfulness": 80}, ("cyberpunk", "neon", "dark", "sci-fi")),
    ("Space", {"space_score": 0.7, "hsv_V_mean": 15, "colorfulness": 50, "unique_colors": 80, "subject_area_ratio": 0.05}, ("space", "galaxy", "dark")),
    ("Nature", {"nature_score": 0.6, "colorfulness": 50, "hsv_S_mean": 50, "hsv_V_mean": 55, "subject_area_ratio": 0.3}, ("nature", "outdoor", "landscape", "green")),
    ("Minimalist", {"texture_entropy": 1.5, "edge_density": 0.05, "unique_colors": 8, "subject_area_ratio": 0.1, "centeredness": 0.7}, ("minimalist", "clean", "monochrome")),
    ("Abstract", {"periodicity_score": 0.5, "texture_entropy": 5.0, "colorfulness": 70, "subject_area_ratio": 0.2, "unique_colors": 200}, ("abstract", "pattern")),
    ("Dark", {"hsv_V_mean": 18, "colorfulness": 25, "space_score": 0.3, "subject_area_ratio": 0.1}, ("dark", "black")),
    ("Pastel", {"pastel_score": 0.5, "hsv_S_mean": 25, "hsv_V_mean": 80, "colorfulness": 35, "anime_score": 0.3}, ("pastel", "light", "soft")),
    ("Vaporwave", {"vw_score": 0.6, "pastel_score": 0.3, "neon_score": 0.3, "colorfulness": 70, "hsv_S_mean": 60}, ("vaporwave", "retro", "neon")),
    ("Portrait", {"skin_fraction": 0.4, "subject_area_ratio": 0.55, "centeredness": 0.6, "aesthetic": 0.7, "sharpness": 300}, ("portrait", "person", "face")),
    ("Illustration", {"anime_score": 0.4, "edge_density": 0.18, "texture_entropy": 4.0, "unique_colors": 128, "colorfulness": 55}, ("illustration", "drawing", "art")),
    ("Photograph", {"aesthetic": 0.8, "sharpness": 500, "colorfulness": 50, "edge_density": 0.10, "texture_entropy": 3.5}, ("photo", "photograph", "realistic")),
    ("Sci-Fi", {"cyberpunk_score": 0.4, "space_score": 0.4, "neon_score": 0.4, "colorfulness": 60, "hsv_V_mean": 30}, ("sci-fi", "futuristic")),
    ("Landscape", {"nature_score": 0.5, "subject_area_ratio": 0.2, "hsv_V_mean": 55, "colorfulness": 50}, ("landscape", "outdoor", "nature")),
    ("Pixel-Art", {"anime_score": 0.3, "unique_colors": 16, "edge_density": 0.30, "texture_entropy": 3.0}, ("pixel-art", "retro", "8-bit")),
    ("Fantasy", {"colorfulness": 65, "subject_area_ratio": 0.35, "sharpness": 300, "aesthetic": 0.6}, ("fantasy", "magic")),
    ("Animals", {"skin_fraction": 0.10, "subject_area_ratio": 0.4, "centeredness": 0.55, "nature_score": 0.3, "aesthetic": 0.6}, ("animal", "nature")),
    ("Cars", {"edge_density": 0.20, "hsv_S_mean": 60, "subject_area_ratio": 0.4, "centeredness": 0.55}, ("car", "vehicle")),
    ("Food", {"hsv_S_mean": 60, "colorfulness": 70, "subject_area_ratio": 0.5, "centeredness": 0.6, "aesthetic": 0.6}, ("food",)),
    ("Sports", {"subject_area_ratio": 0.3, "edge_density": 0.18, "hsv_S_mean": 60, "aesthetic": 0.5}, ("sport",)),
    ("Music", {"colorfulness": 60, "subject_area_ratio": 0.4, "centeredness": 0.55, "edge_density": 0.18}, ("music",)),
    ("Game", {"anime_score": 0.4, "colorfulness": 70, "edge_density": 0.20, "unique_colors": 200}, ("game", "digital-art")),
    ("Pattern", {"periodicity_score": 0.7, "texture_entropy": 4.5, "is_periodic": 0.7, "subject_area_ratio": 0.1, "unique_colors": 64}, ("pattern", "abstract", "tile")),
    ("Aesthetic", {"colorfulness": 45, "aesthetic": 0.7, "pastel_score": 0.3, "subject_area_ratio": 0.4}, ("aesthetic", "vibe")),
)

#: Leading phrases that are removed from written descriptions.
BAD_LEADS = ("the image features", "a unified aesthetic can be achieved", "a unified aesthetic combines", "the unified aesthetic", "this category", "category:")

# The limits of the gates before classification.
GATES = {"most_bytes": 104_857_600, "least_sharpness": 80.0, "nsfw": 0.5, "reply_unsure": 0.65, "reply_nsfw": 0.70}

# Tags that cleaning never removes, tags of the adult folder, soft priors, name markers of models that see images.
ALWAYS_KEPT = ("anime", "photograph", "photo", "illustration", "digital-art", "pixel-art", "painting", "sketch", "3d-render", "minimalist", "monochrome", "portrait", "landscape")
ADULT_TAGS = ("nsfw", "figure", "human", "skin", "portrait", "person", "body")
PRIORS = {"Nature": 1.05, "Anime": 1.05, "Abstract": 1.02, "Minimalist": 1.02, "Photograph": 1.02}
SEEING_MODELS = ("llava", "vision", "vl", "minicpm-v", "moondream", "bakllava", "granite3.1-vision", "qwen2.5vl", "qwen-vl", "internvl")
BLIND_MODELS = ("-text", "embed")
