"""Languages, scripts and language groups, as plain tables and as DataFrames; parsing of their names."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

UNKNOWN = "unknown"
#: Scripts in their order, with the weight of a character and the Unicode scripts they are made of.
ALPHABETS = {
    "LATIN": (1.0, ("Latin",)),
    "HAN": (3.0, ("Han",)),
    "JA_KANA": (2.0, ("Hiragana", "Katakana")),
    "HANGUL": (2.0, ("Hangul",)),
    "ARABIC": (1.25, ("Arabic",)),
    "ARMENIAN": (1.0, ("Armenian",)),
    "BENGALI": (1.0, ("Bengali",)),
    "CYRILLIC": (1.0, ("Cyrillic",)),
    "DEVANAGARI": (1.0, ("Devanagari",)),
    "ETHIOPIC": (1.0, ("Ethiopic",)),
    "GEORGIAN": (1.0, ("Georgian",)),
    "GREEK": (1.0, ("Greek",)),
    "GUJARATI": (1.0, ("Gujarati",)),
    "GURMUKHI": (1.0, ("Gurmukhi",)),
    "HEBREW": (1.0, ("Hebrew",)),
    "KANNADA": (1.0, ("Kannada",)),
    "KHMER": (1.0, ("Khmer",)),
    "LAO": (1.0, ("Lao",)),
    "MALAYALAM": (1.0, ("Malayalam",)),
    "MYANMAR": (1.0, ("Myanmar",)),
    "SINHALA": (1.0, ("Sinhala",)),
    "TAMIL": (1.0, ("Tamil",)),
    "TELUGU": (1.0, ("Telugu",)),
    "THAI": (1.0, ("Thai",)),
}
CJ_ALPHABETS = ("HAN", "JA_KANA")

#: Languages in their order (ties go to the first), as name, ISO code, three-letter code, other names, scripts.
_ROWS = (
    ("afrikaans", "af", "afr", "", "LATIN"),
    ("albanian", "sq", "sqi", "", "LATIN"),
    ("azerbaijani", "az", "aze", "", "LATIN"),
    ("basque", "eu", "eus", "", "LATIN"),
    ("catalan", "ca", "cat", "", "LATIN"),
    ("croatian", "hr", "hrv", "", "LATIN"),
    ("czech", "cs", "ces", "", "LATIN"),
    ("danish", "da", "dan", "", "LATIN"),
    ("dutch", "nl", "nld", "", "LATIN"),
    ("english", "en", "eng", "", "LATIN"),
    ("esperanto", "eo", "epo", "", "LATIN"),
    ("estonian", "et", "est", "", "LATIN"),
    ("finnish", "fi", "fin", "", "LATIN"),
    ("french", "fr", "fra", "", "LATIN"),
    ("ganda", "lg", "lug", "", "LATIN"),
    ("german", "de", "deu", "", "LATIN"),
    ("hungarian", "hu", "hun", "", "LATIN"),
    ("icelandic", "is", "isl", "", "LATIN"),
    ("indonesian", "id", "ind", "", "LATIN"),
    ("italian", "it", "ita", "", "LATIN"),
    ("irish", "ga", "gle", "gaelic", "LATIN"),
    ("latin", "la", "lat", "", "LATIN"),
    ("latvian", "lv", "lav", "", "LATIN"),
    ("lithuanian", "lt", "lit", "", "LATIN"),
    ("luxembourgish", "lb", "ltz", "", "LATIN"),
    ("malay", "ms", "msa", "malaysian", "LATIN"),
    ("maori", "mi", "mri", "", "LATIN"),
    ("norwegian", "no", "nor", "bokmal nb", "LATIN"),
    ("nynorsk", "nn", "nno", "", "LATIN"),
    ("oromo", "om", "orm", "", "LATIN"),
    ("polish", "pl", "pol", "", "LATIN"),
    ("portuguese", "pt", "por", "", "LATIN"),
    ("romanian", "ro", "ron", "", "LATIN"),
    ("shona", "sn", "sna", "", "LATIN"),
    ("slovak", "sk", "slk", "", "LATIN"),
    ("slovenian", "sl", "slv", "slovene", "LATIN"),
    ("somali", "so", "som", "", "LATIN"),
    ("sotho", "st", "sot", "", "LATIN"),
    ("spanish", "es", "spa", "", "LATIN"),
    ("swahili", "sw", "swa", "", "LATIN"),
    ("swedish", "sv", "swe", "", "LATIN"),
    ("tagalog", "tl", "tgl", "", "LATIN"),
    ("tsonga", "ts", "tso", "", "LATIN"),
    ("tswana", "tn", "tsn", "", "LATIN"),
    ("turkish", "tr", "tur", "", "LATIN"),
    ("vietnamese", "vi", "vie", "", "LATIN"),
    ("welsh", "cy", "cym", "", "LATIN"),
    ("xhosa", "xh", "xho", "", "LATIN"),
    ("yoruba", "yo", "yor", "", "LATIN"),
    ("zulu", "zu", "zul", "", "LATIN"),
    ("chinese_simplified", "zh-hans", "zho-hans", "chinese zh zh-cn zh-hans-cn zh-hans-sg", "HAN"),
    ("chinese_traditional", "zh-hant", "zho-hant", "zh-hant-hk zh-hk zh-hant-tw zh-tw", "HAN"),
    ("japanese", "ja", "jpn", "jp", "HAN JA_KANA"),
    ("korean", "ko", "kor", "", "HANGUL"),
    ("arabic", "ar", "ara", "", "ARABIC"),
    ("pashto", "ps", "pus", "", "ARABIC"),
    ("persian", "fa", "fas", "farsi", "ARABIC"),
    ("urdu", "ur", "urd", "", "ARABIC"),
    ("belarusian", "be", "bel", "", "CYRILLIC"),
    ("bulgarian", "bg", "bul", "", "CYRILLIC"),
    ("macedonian", "mk", "mkd", "", "CYRILLIC"),
    ("mongolian", "mn", "mon", "", "CYRILLIC"),
    ("russian", "ru", "rus", "", "CYRILLIC"),
    ("serbian", "sr", "srp", "", "CYRILLIC"),
    ("ukrainian", "uk", "ukr", "", "CYRILLIC"),
    ("amharic", "am", "amh", "", "ETHIOPIC"),
    ("tigrinya", "ti", "tig", "", "ETHIOPIC"),
    ("armenian", "hy", "hye", "", "ARMENIAN"),
    ("bengali", "bn", "ben", "", "BENGALI"),
    ("burmese", "my", "mya", "myanmar", "MYANMAR"),
    ("georgian", "ka", "kat", "", "GEORGIAN"),
    ("greek", "el", "ell", "", "GREEK"),
    ("gujarati", "gu", "guj", "", "GUJARATI"),
    ("hebrew", "he", "heb", "", "HEBREW"),
    ("hindi", "hi", "hin", "", "DEVANAGARI"),
    ("kannada", "kn", "kan", "", "KANNADA"),
    ("khmer", "km", "khm", "", "KHMER"),
    ("lao", "lo", "lao", "", "LAO"),
    ("malayalam", "ml", "mal", "", "MALAYALAM"),
    ("punjabi", "pa", "pan", "", "GURMUKHI"),
    ("sinhala", "si", "sin", "", "SINHALA"),
    ("tamil", "ta", "tam", "", "TAMIL"),
    ("telugu", "te", "tel", "", "TELUGU"),
    ("thai", "th", "tha", "", "THAI"),
)


@dataclass(frozen=True)
class Language:
    ord: int
    name: str
    iso: str
    iso3: str
    aliases: tuple[str, ...]
    alphabets: tuple[str, ...]

    @property
    def is_chinese(self) -> bool:
        return self.iso in ("zh-hans", "zh-hant")


LANGUAGES = [Language(i, name, iso, iso3, tuple(aliases.split()), tuple(scripts.split())) for i, (name, iso, iso3, aliases, scripts) in enumerate(_ROWS)]
BY_ISO = {x.iso: x for x in LANGUAGES}
_BY_NAME = {n.lower(): x for x in reversed(LANGUAGES) for n in (*x.aliases, x.iso3, x.iso, x.name)}


def for_alphabet(alphabet: str) -> list[str]:
    return [x.iso for x in LANGUAGES if alphabet in x.alphabets]


def unique_alphabet() -> list[str]:
    """Languages that have a script of their own."""
    users = Counter(a for x in LANGUAGES for a in x.alphabets)
    return [x.iso for x in LANGUAGES if all(users[a] == 1 for a in x.alphabets)]


def ordered(isos) -> list[str]:
    """Distinct codes in the order of the languages."""
    return [x.iso for x in LANGUAGES if x.iso in set(isos)]


def _groups() -> dict[str, list[str]]:
    #: Members of the named groups that follow from nothing else.
    efigs = "en fr it de es".split()
    efigsnp = efigs + "nl pt".split()
    nordic = "da sv no fi".split()
    west = efigsnp + nordic
    latin = "sq eu ca hr cs da nl en et fi fr de hu is it ga lv lt lb no nn pl pt ro sk sl es sv tr cy".split()
    east = "sq hr cs et hu lv lt pl ro sk sl".split()
    cyrillic = "be bg mk ru sr uk".split()
    groups = {
        "all": [x.iso for x in LANGUAGES],
        "cj": "zh-hans zh-hant ja".split(),
        "cjk": "zh-hans zh-hant ja ko".split(),
        "efigs": efigs,
        "efigsnp": efigsnp,
        "nordic": nordic,
        "europe_west_common": west,
        "europe_common": west + east + cyrillic,
        "europe_east_latin": east,
        "europe_latin": latin,
        "europe_cyrillic": cyrillic,
        "europe": latin + cyrillic,
        "latin_alphabet": for_alphabet("LATIN"),
        "cyrillic_alphabet": for_alphabet("CYRILLIC"),
        "arabic_alphabet": for_alphabet("ARABIC"),
        "unique_alphabet": unique_alphabet(),
    }
    return {k: ordered(v) for k, v in groups.items()}


GROUPS = _groups()


def parse_language(text: str) -> str:
    """Code of a language given by name, code or other name in any case; else `unknown`."""
    found = _BY_NAME.get(text.strip().lower())
    return found.iso if found else UNKNOWN


def parse_alphabet(text: str) -> str:
    return text.strip().upper() if text.strip().upper() in ALPHABETS else "UNKNOWN"


def parse_languages(text: str) -> list[str]:
    """Codes of a list of names and groups, separated by commas; duplicates stay, an unknown name is an error."""
    out = []
    for part in filter(None, (p.strip().lower() for p in text.split(","))):
        if part in GROUPS:
            out += GROUPS[part]
        elif (iso := parse_language(part)) != UNKNOWN:
            out.append(iso)
        else:
            raise ValueError(f"unknown language or group: {part}")
    return out


def is_equivalent(a: str, b: str) -> bool:
    """The same language, or both Chinese."""
    return a == b or all(x in BY_ISO and BY_ISO[x].is_chinese for x in (a, b))


def languages(spark: SparkSession, alphabet: str | None = None) -> DataFrame:
    rows = [(x.ord, x.name, x.iso, x.iso3, list(x.aliases), list(x.alphabets)) for x in LANGUAGES if alphabet is None or alphabet in x.alphabets]
    return spark.createDataFrame(rows, "lang_ord int, name string, iso string, iso3 string, aliases array<string>, alphabets array<string>")


def alphabets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, w) for i, (n, (w, _)) in enumerate(ALPHABETS.items())], "alpha_ord int, name string, weight double")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, i) for g, members in GROUPS.items() for i in members], "alias string, iso string")
