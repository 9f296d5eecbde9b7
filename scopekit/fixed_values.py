"""Values that must be equal to the ones of the extraction pipeline this
engine re-implements, so that prompts, records and scores come out the same.

FIXED VALUES: the strings and numbers in this module are copied as plain
text, in their natural order, and must not be edited.
"""

# --- FIXED VALUES: page relevance -------------------------------------------
# Folding applied, in this order, after lower-casing and removing U+0020.
RELEVANCE_FOLDS = (("one", "1"), ("two", "2"), ("three", "3"), ("scopes", "scope"))
# A page is relevant when the folded text contains any of these terms.
RELEVANCE_TERMS = ("scope1", "scope2", "scope3")

# --- FIXED VALUES: page budget ----------------------------------------------
DEFAULT_MAX_TOKENS = 65536
CHARACTERS_PER_TOKEN = 3.5

# --- FIXED VALUES: prompt ---------------------------------------------------
# Instruction text (whole template file, trailing newline included).
INSTRUCTION = (
    "You will be given chunks of text extracted from a sustainability report PDF document by a "
    "corporation. Each chunk is a single page of the PDF document and might not just contain flow "
    "text, but also text extracted from graphs, tables or similar structures. Your task is to "
    "extract the gross scope 1, 2 and 3 greenhouse gas emissions. If values for multiple years are "
    "given, extract the value for the most recent year. For scope 2 emissions, extract only "
    "market-based emissions. Output this information as a JSON object in the <FORMAT>. Output only "
    "a single number for each of the scope 1, 2, and 3 emissions. If the chunks provide more "
    "detailed values, ignore them and output only the total value. If emission values are provided "
    "for subsidiaries, ignore them and only output the total value. It may be possible that the "
    "emission values are ambiguous (e.g. scope 1 and 2 emissions reported together as a single "
    "number) or don't exist at all. In this case, simply output `null`. Be sure to only output a "
    "number if you are certain that it is correct. Extract scope 3 emissions based on generic "
    "emissions factors if multiple versions are given. Emission values may be reported in "
    "kilotons (thousand tons) or megatons (million tons). Convert these values into metric tons. "
    "The `source` field should be a list of ids of the chunks which contain the extracted "
    "emission values.\n"
    "<FORMAT>\n"
    '{"scope_1": int | null, "scope_2": int | null, "scope_3": int | null, "sources": int[]}}\n'
    "</FORMAT>\n"
)
# Marker that ends the instruction; a prompt ending in it has no page text.
FORMAT_END = "</FORMAT>"
# Fixed start of the answer appended after the chat template.
ANSWER_START = (
    " I have extracted the Scope 1, 2 and 3 emission values from the document, converted them "
    "into metric tons and put them into the following json object:\n```json\n"
)
# User-turn chat wrappers (prefix, suffix) by model family, begin-of-text marker stripped.
CHAT_WRAPPERS = {
    "mistral": ("[INST] ", " [/INST]"),
    "chatml": ("<|im_start|>system\nYou are a helpful assistant<|im_end|>\n<|im_start|>user\n",
               "<|im_end|>\n<|im_start|>assistant\n"),
    "openchat": ("GPT4 Correct User: ", "<|end_of_turn|>GPT4 Correct Assistant:"),
}
# End-of-sequence marker printed by the scoring engine.
EOS_MARKER = "</s>"
# The same by model family.
EOS_MARKERS = {"mistral": "</s>", "openchat": "<|end_of_turn|>", "chatml": "[PAD151643]"}

# --- FIXED VALUES: context plan ---------------------------------------------
CONTEXT_MARGIN = 120
DISABLED_NEIGHBOUR = 1
DISABLED_WINDOW = 512
QWEN_TOKEN_SCALE = 1.2
DEFAULT_MAX_NEIGHBOUR = 8
DEFAULT_MAX_WINDOW = 2048

# --- FIXED VALUES: model configuration (JSON object keyed by model name) -----
MODEL_CONFIG_JSON = (
    '{"mistral": {"context_size": 32768, "model_path": "models/Mistral-7B-Instruct-v0.2"}, '
    '"openchat": {"context_size": 8192, "model_path": "models/openchat-3.5-0106"}, '
    '"qwen": {"context_size": 8192, "model_path": "models/Qwen-1_8B-Chat"}, '
    '"mixtral": {"context_size": 32768, "model_path": "models/Mixtral-8x7B-Instruct-v0.1"}, '
    '"miqu": {"context_size": 32764, "model_path": "models/miqu-1-70b-pytorch"}}'
)
MODEL_NAMES = ("mistral", "openchat", "qwen", "mixtral", "miqu")

# --- FIXED VALUES: output records -------------------------------------------
STUB_JSON = '{"scope_1":-1,"scope_2":-1,"scope_3":-1,"sources":[-1]}'
FAILED_VALUE = -1
CLIP_MIN = -1
CLIP_MAX = 1000000000
MAX_SOURCES = 5

# --- FIXED VALUES: accuracy -------------------------------------------------
STRICT_RTOL = 1e-5
STRICT_ATOL = 1e-8
TOLERANT_RTOL = 0.1
TOLERANT_ATOL = 1.0
SCOPE_KEYS = ("scope_1", "scope_2", "scope_3")

# --- FIXED VALUES: training record templates --------------------------------
SFT_TEMPLATE_MISTRAL = "[INST] {instruction} [/INST]" + ANSWER_START
SFT_TEMPLATE_QWEN = (
    "<|im_start|>system\nYou are a helpful assistant<|im_end|>\n<|im_start|>user\n{instruction}"
    "<|im_end|>\n<|im_start|>assistant\n" + ANSWER_START
)
DPO_TEMPLATE_MISTRAL = "[INST] {prompt} [/INST]" + ANSWER_START
# Rejected (wrong) records: value = int(u * 10**e), u in [0, 1), e in 0..6;
# sources = one page in 0..300.
REJECTED_MAX_EXPONENT = 6
REJECTED_MAX_PAGE = 300
