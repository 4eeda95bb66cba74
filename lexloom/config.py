"""Fixed values and parameters shared by all jobs.

Everything a job can be tuned with is here: the script whose characters are
taught, the punctuation classes, the question types and the thresholds of the
spaced-repetition model.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Script:
    """The writing system that is being taught.

    ``chars`` is the body of a regex character class, ``unit`` matches one
    segmentation unit (a character for CJK, a word for alphabets) and ``joiner``
    puts units back together.
    """

    chars: str
    unit: str
    joiner: str


CJK = Script(chars=r"\x{4e00}-\x{9fff}", unit=r"[\x{4e00}-\x{9fff}]", joiner="")
LATIN = Script(chars="a-zà-ÿ", unit="[a-zà-ÿ]+", joiner=" ")

# --- fixed values: punctuation classes -------------------------------------
PUNCT_BANK_FIRST = "。？！，、；：\"'….?!,"
PUNCT_BANK = "。？！，、；：\"'.?!,"
PUNCT_BLOCKLIST = "。？！，、；：\"….?!,"
PUNCT_ROMANISE = "。？！，、；：\"…"
PUNCT_ANSWER = ".,/#!$%^&*;:{}=-_`~()。？！、，：；\"'"

WIDE_PUNCT = "，。？！：；（）“”‘’　"
NARROW_PUNCT = ",.?!:;()\"\"'' "

# --- fixed values: question types, best review type first ------------------
# name, tier, speaking, sentence-based, source of the item
QUESTION_TYPES = [
    ("listening sentence", 2, False, True, "sentence"),
    ("speaking sentence", 2, True, True, "sentence"),
    ("speaking vocab", 1, True, False, "word"),
    ("listening vocab", 1, False, False, "word"),
    ("transcribe word to pinyin", 1, False, False, "word"),
    ("translate english sentence to chinese", 3, False, True, "sentence"),
    ("translate english word to chinese", 2, False, False, "word"),
    ("fill in the blank", 1, False, False, "cloze"),
    ("translate chinese sentence to english", 2, False, True, "sentence"),
    ("translate chinese word to english", 1, False, False, "word"),
]
TYPE_NAMES = [t[0] for t in QUESTION_TYPES]
TYPE_SLUGS = [t[0].replace(" ", "_") for t in QUESTION_TYPES]
SENTENCE_TYPES = [t[0] for t in QUESTION_TYPES if t[3]]
UNIT_TAG_PREFIX = "unit_"

# --- fixed values: which questions an item yields --------------------------
# kind -> (question type, question field, answer field)
QUESTION_PLAN = {
    "vocab": [
        ("listening vocab", "text", "reading"),
        ("speaking vocab", "text", "reading"),
        ("translate english word to chinese", "gloss", "text"),
        ("translate chinese word to english", "text", "gloss"),
        ("transcribe word to pinyin", "text", "reading"),
    ],
    "grammar": [
        ("listening vocab", "text", "reading"),
        ("speaking vocab", "text", "reading"),
        ("transcribe word to pinyin", "text", "reading"),
    ],
    "proper_noun": [
        ("listening vocab", "text", "reading"),
        ("speaking vocab", "text", "reading"),
        ("transcribe word to pinyin", "text", "reading"),
    ],
    "sentence": [
        ("listening sentence", "text", "text"),
        ("speaking sentence", "text", "reading"),
        ("translate english sentence to chinese", "gloss", "text"),
        ("translate chinese sentence to english", "text", "gloss"),
    ],
    "cloze": [("fill in the blank", "question", "answer")],
}

# --- fixed values: lexicon sections, in order of precedence ----------------
SECTIONS = [("vocab", "vocab"), ("grammar", "grammar"), ("proper_nouns", "proper_noun")]
GRAMMAR_POS_PREFIXES = ("part", "aux", "助")
UNCLEAR = "[unclear]"
POS_NAMES = {
    "n.": "noun",
    "v.": "verb",
    "adj.": "adjective",
    "adv.": "adverb",
    "pron.": "pronoun",
    "num.": "numeral",
    "m.": "measure_word",
    "part.": "particle",
    "": "other",
}

# --- fixed values: section markers of the course text ----------------------
EXERCISE_MARKERS = ["练习", "Exercises", "运用", "Application", "小组活动", "双人活动", "Group Work", "Pair Work"]
EXERCISE_END_MARKERS = ["拼音", "Pinyin", "汉字", "Characters", "文化", "CULTURE"]
SKIPPED_HEADINGS = ["听力", "Listening", "picture", "Picture", "汉字", "Characters", "Matching", "matching"]
QUALITY_MARKERS = {
    "unclear": "[unclear]",
    "blank_page": "[blank page]",
    "non_text_page": "[non-text page]",
    "illustration": "[illustration",
}

# --- fixed values: readings of words whose usual reading would be wrong ----
READING_OVERRIDES = {"谁": "shei2"}
MARKER_READINGS = {
    "不": "bu4",
    "个": "ge4",
    "了": "le5",
    "吗": "ma5",
    "呢": "ne5",
    "吧": "ba5",
    "啊": "a5",
    "的": "de5",
    "地": "de5",
    "得": "de5",
    "着": "zhe5",
    "过": "guo5",
}

# --- fixed values: romanised syllables -------------------------------------
SYLLABLE_INITIALS = "zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw]"
SYLLABLE_FINALS = (
    "iang|iong|uang|ueng|uan|uen|uai|ing|ang|eng|ong|ian|iao|"
    "ie|in|an|en|ao|ou|ai|ei|ia|ua|uo|ui|un|iu|ve|vn|er|ng|a|o|e|i|u|v"
)
TONE_MARKED = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜ"
TONE_PLAIN = "aaaaeeeeiiiioooouuuuvvvv"
TONE_DIGITS = "123412341234123412341234"


@dataclass(frozen=True)
class Rules:
    """Thresholds of the learner model and the session builder."""

    first_unit: int = 3
    last_unit: int = 99
    test_size: int = 20
    pass_ratio: float = 0.80
    session_size: int = 10
    max_per_tag: int = 2
    graduation_count: int = 3
    weak_below: float = 0.70
    tier_unlock: tuple[int, int, int] = (0, 2, 4)
    easy_after: int = 2
    easy_count: int = 10
    stability_floor: float = 1.0
    stability_cap: float = 365.0
    seed_stability: float = 1.0
    seed_age_days: int = 365
    transcript_ratio: int = 3

    @property
    def pass_count(self) -> int:
        return round(self.pass_ratio * self.test_size)


RULES = Rules()
