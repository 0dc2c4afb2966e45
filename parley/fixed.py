"""Values that results depend on, stated once.

Everything in this module is a fixed value: column-name patterns, role words,
prompt texts, token limits. Logic that uses them lives elsewhere.
"""

# --- fixed values: column names that select a layout (matched whole, any case) ---
CONVERSATION_NAMES = r"^conversations?$"
MESSAGE_NAMES = (r"^messages?$", r"^texts?$", r"^content$")
MEDIA_NAMES = (r"^images?$", r"^audios?$", r"^videos?$")
USER_NAMES = r"^(question|instruction|user|input|questions)$"
ASSISTANT_NAMES = r"^(answer|response|assistant|output|answers)$"
SYSTEM_NAMES = r"^(definition|instruction)$"
CHOSEN_NAMES = r"^chosen$"
REJECTED_NAMES = r"^rejected$"
ROLE_NAMES = r"^role$"
TEXT_NAMES = r"^text$"
CAPTION_NAMES = r"^caption$"
LABEL_NAMES = r"^label$"

# --- fixed values: message keys, in order of preference ---
ROLE_KEYS = ("role", "from")
CONTENT_KEYS = ("content", "value")

# --- fixed values: words that identify a role, in order of preference ---
ROLE_WORDS = {
    "system": ("system", "instruction"),
    "user": ("user", "human", "input"),
    "assistant": ("assistant", "gpt", "output", "response"),
}

# --- fixed values: prompt texts ---
IMAGE_QUESTION = "What in this images?"
DEFAULT_SYSTEM = "You are a helpful assistant."
PROMPT_SYSTEM = (
    "You are a helpful assistant. Answer questions based on the image if provided."
)
MESSAGE_START = "<|im_start|>"
MESSAGE_END = "<|im_end|>"

# --- fixed values: token limits and label constants ---
MAX_TEXT_TOKENS = 1000
MAX_MEDIA_TOKENS = 10000
MAX_VISION_TOKENS = 250
IMAGE_SLOTS = 257
IGNORED_LABEL = -100
PAD_MULTIPLE = 8
NORM_EPS = 1e-12

# --- fixed values: files and names ---
DATASET_FILES = ("*.json", "*.csv", "*.parquet", "*.zip")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
AUDIO_EXTENSIONS = ("mp3", "wav")
FORMATTED_SUFFIX = "_formatted"
UNION_PREFIX = "concat_"
TEXT_TASK = "text-generation"
VISION_TASK = "text-vision-text-generation"

# --- fixed values: Unicode whitespace, as characters and as a Java regex class ---
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)

# Characters of a rendered turn besides its role and content.
LEAST_TURN = 30

# Rows of one file of token rows. Files are dealt to tasks by bytes, and padding, which is most
# of the work, takes hardly any: many small files are dealt evenly, whatever they hold.
FILE_ROWS = 10_000
