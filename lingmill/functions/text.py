"""Words of a text: tokenizers for detection and training, apostrophes, accents, wiki markup, snippets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .catalog import ALPHABETS, CJ_ALPHABETS

APOSTROPHES = "'’\u0092"
LONGEST, LONGEST_CJ = 64, 256
#: A chunk that is a word as it is.
EASY = "^[a-z]+$"


def letters(alphabet: str, dialect: str = "java") -> str:
    """Inside of a character class with the letters of a script. dialect: java or re2.

    In Java's, ASCII characters are told by their range, and only others by their script, which is slow to look up.
    """
    scripts = "".join(rf"\p{{{'Is' if dialect == 'java' else ''}{s}}}" for s in ALPHABETS[alphabet][1])
    if dialect != "java":
        return scripts
    return ("a-zA-Z" if alphabet == "LATIN" else "") + rf"[[^\x00-\x7F]&&[{scripts}]]"


def word_pattern(alphabets: list[str], dialect: str = "java", digit: str = "0-9") -> str:
    """A run of letters of one script, with digits anywhere and single apostrophes after a letter or digit.

    In Java's, digits before the first letter are looked at from the first of them only, so that long numbers take linear time.
    """
    java = dialect == "java"
    keep = "+" if java else ""
    lead = rf"(?:(?<![{digit}])[{digit}]++)?+" if java else f"[{digit}]*"
    branches = [f"{lead}[{c}][{c}{digit}]*{keep}(?:[{APOSTROPHES}][{digit}]*[{c}][{c}{digit}]*{keep})*{keep}(?:[{APOSTROPHES}][{digit}]*{keep})?" for c in (letters(a, dialect) for a in alphabets)]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def lowered(word: Column) -> Column:
    return F.lower(F.translate(word, "İ", "i"))


def script_of(chunk: Column, alphabets: list[str]) -> Column:
    """The script of a chunk that word_pattern found."""
    out = F.lit(alphabets[-1])
    for a in reversed(alphabets[:-1]):
        out = F.when(chunk.rlike(f"[{letters(a)}]"), F.lit(a)).otherwise(out)
    return F.when(chunk.rlike(EASY), F.lit("LATIN")).otherwise(out) if "LATIN" in alphabets and len(alphabets) > 1 else out


def chunks(text: Column, alphabets: list[str], digit: str = "0-9") -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(word_pattern(alphabets, digit=digit)), F.lit(0))


def folded(chunk: Column, digit: str = "[0-9]") -> Column:
    """A chunk without digits, in lower case, apostrophes made one."""
    return F.translate(lowered(F.regexp_replace(chunk, digit, "")), APOSTROPHES, "'" * len(APOSTROPHES))


def detection_words(chunk: Column, script: Column) -> Column:
    """The words of a chunk: none for a Latin one with a digit; cut at 64 characters, or every 256 for Chinese and Japanese."""
    word, cj = folded(chunk), script.isin(*CJ_ALPHABETS)
    trim = lambda w: F.regexp_replace(w, "'$", "")
    cut = F.when(cj, F.transform(F.regexp_extract_all(word, F.lit(f"(?s).{{1,{LONGEST_CJ}}}"), F.lit(0)), trim)).otherwise(F.array(trim(F.substring(word, 1, LONGEST))))
    return F.filter(F.when((script == "LATIN") & chunk.rlike("[0-9]"), F.array().cast("array<string>")).otherwise(cut), lambda w: w != "")


def plain_word(chunk: Column) -> Column:
    """The word of a chunk that is neither Chinese nor Japanese nor a Latin one with a digit. Most need no more than a look."""
    cut = F.substring(folded(chunk), 1, LONGEST)
    return F.when(chunk.rlike(EASY), F.substring(chunk, 1, LONGEST)).otherwise(F.regexp_replace(cut, "'$", ""))


def mid_apostrophe(word: Column) -> Column:
    """Position (from 1) of the first apostrophe that is neither first nor last; 0 if none."""
    at = F.locate("'", word, 2)
    return F.when((at > 0) & (at < F.length(word)) & ~F.startswith(word, F.lit("'")), at).otherwise(0)


def snippet(text: Column, size: int = 80) -> Column:
    flat = F.translate(text, "\n", " ")
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def human_bytes(n: Column) -> Column:
    """1536 -> 1.5K."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in ((1, "K"), (2, "M"), (3, "G"), (4, "T")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f{unit}", n / float(1024**power))).otherwise(out)
    return out


#: Plain form -> the accented, modified and joined small letters that become it; a letter under two forms takes the last.
PLAIN_LETTERS = {
    "a": "ａªᵃₐáàăắằẵẳâấầẫẩǎåǻäǟãȧąāảȁȃạặậḁᴀⱥɐɑɒ",
    "ae": "æǽǣ",
    "b": "ｂḃḅḇʙƀɓƃꞵ",
    "c": "ｃᶜćĉčċçḉᴄȼꞓɕↄ",
    "d": "ｄďḋḑđḍḓḏðʤᴅɖɗ",
    "e": "ｅᵉᴱéèĕêếềễểěëẽėȩḝęēḗḕẻȅȇẹệḛᴇɇǝəᵊɛɘɚɜɝɞɤ",
    "f": "ｆḟƒⅎ",
    "ff": "ﬀ",
    "fi": "ﬁ",
    "ffi": "ﬃ",
    "fl": "ﬂ",
    "g": "ｇǵğĝǧġģḡᵹɡɢǥɠɣˠƣ",
    "h": "ｈʰĥȟḧḣḩħḥḫẖʜƕɦʱɧ",
    "i": "ｉⅰⁱᵢíìĭîǐïḯĩįīỉȉȋịḭıɪᴉɨᵻɩ",
    "ii": "ⅱ",
    "iii": "ⅲ",
    "ij": "ĳ",
    "iv": "ⅳ",
    "j": "ｊʲĵǰȷᴊʝɟʄ",
    "k": "ｋḱǩķḳḵƙⱪꝃʞ",
    "l": "ｌˡĺľļłḷḹḻŀʟƚⱡɫɬɭɮƛʎ",
    "m": "ᵐᴹḿṁṃᴍɱ",
    "n": "ｎⁿńǹňñṅņṇṋṉɴᵰɲƞꞑᶇɳŋᵑ",
    "o": "ｏºᵒóòŏôốồỗổǒöȫőõȭȯøǿǫǭōṓṑỏȍȏơớờỡởợọộᴏɔᵓᴖᴗɵɷⱷ",
    "oe": "œɶ",
    "oo": "ꝏ",
    "ou": "ȣ",
    "p": "ｐṕṗᴘƥɸⱷ",
    "q": "ꝗĸ",
    "r": "ｒʳŕřṙŗȓṛṝṟꝛʀɍɹᴚɺɻɼɽɾɿʁ",
    "s": "ｓśṥŝšṧṡşṣșſꜱʂʃ",
    "ss": "ß",
    "st": "ﬆ",
    "t": "ｔᵀťẗṫţṭțṱṯʨʦᴛŧƭʈȶʇ",
    "tf": "ʧ",
    "u": "ｕᵘúùŭûǔůüǘǜǚǖűũųūṻủȕȗưứừữửựụṳṷṵʉɥɯɰʊ",
    "v": "ｖⅴᵛṽṿᴠʋⱱʌ",
    "vi": "ⅵ",
    "vii": "ⅶ",
    "w": "ｗʷẃẁŵẅʍ",
    "x": "ｘⅹₓẍẋꭓ",
    "y": "ｙʸýỳŷÿỹẏȳỷỵʏɏƴỿȝ",
    "z": "źẑžżẓẕᴢƶȥʐʑ",
}


def accent_map() -> dict[str, str]:
    """letter -> plain form."""
    return {c: plain for plain, letters in PLAIN_LETTERS.items() for c in letters}


def remove_accents(text: Column) -> Column:
    """text with accented small letters made plain; capitals and what has no plain form stay."""
    table = accent_map()
    one = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(text, "".join(one), "".join(one.values()))
    for k, v in table.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(text.rlike("[^\\x00-\\x7F]"), out).otherwise(text)


#: What markup begins with: a table row at the start of a line, something nested, a tag, an entity, an address that goes on after its slashes.
MARKUP = re.compile(r"(?m)^\|[^\n]*|(?P<nested>\[\[|\{\{|\{\|)|<[^>\n]*>?|&[A-Za-z]+;|https?://(?=[\s\S])[^\x00-\x20\]]*")
CLOSERS = {"[[": "]]", "{{": "}}", "{|": "|}"}
NESTED = {a: re.compile(f"{re.escape(a)}|{re.escape(b)}") for a, b in CLOSERS.items()}


def strip_markup(text: str) -> str:
    """text without wiki markup: table rows (but not their line breaks), links, templates, tables, tags, entities, addresses.

    What is nested goes with all that it holds; if it is never closed, so does the rest of the text.
    """
    kept, pos = [], 0
    while found := MARKUP.search(text, pos):
        kept.append(text[pos : found.start()])
        pos = _closed(text, found["nested"], found.end()) if found["nested"] else found.end()
    return "".join([*kept, text[pos:]])


def _closed(text: str, opener: str, pos: int) -> int:
    """Where what was opened before pos ends."""
    stack = [opener]
    for bracket in NESTED[opener].finditer(text, pos):
        if bracket[0] == opener:
            stack.append(opener)
        else:
            stack.pop()
        if not stack:
            return bracket.end()
    return len(text)


@F.pandas_udf(StringType())
def remove_markup(texts: pd.Series) -> pd.Series:
    """strip_markup for a column: nested delimiters are beyond regular expressions."""
    return texts.map(strip_markup, na_action="ignore")
