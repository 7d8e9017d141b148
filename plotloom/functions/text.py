"""Column functions over dialogue, questions and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules, in the order in which they are tried.
ANSWER_PATTERNS = (r"answer\s+is\s+([A-D])", r"answer:\s*([A-D])", r"select\s+([A-D])", r"option\s+([A-D])", r"choose\s+([A-D])", r"\b([A-D])\s*[.):]")
CREDIT_WORDS = ("written", "transcribed", "originally", "minor", "adjustment", "story", "teleplay", "directed")
GROUP_SPEAKERS = ("ALL", " AND ", ")", "(", "GUYS", "GIRLS", "BOTH", "ITNERCOM", " TO ")
MARKS = (";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!")
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")
LETTERS = "ABCD"
#: White space in every script, which the engines' own classes leave out in part.
BLANK = r"\t\n\x0B\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same for Java, whose matcher asks the parts of a class in turn: other letters are told apart by one range, Latin ones by a table.
_BLANK = r"\t\n\x0B\f\r\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
CAPTION_MARKS = r".!\"()*#:;~"
# Contractions without their apostrophes, and with them. Keys with capitals never meet lower-case words.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's",
    "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't",
    "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't",
    "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't",
    "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at",
    "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've", "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've",
    "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've",
    "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've",
    "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've",
    "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's",
    "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll",
    "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've",
    "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've",
    "youll": "you'll", "youre": "you're", "youve": "you've",
}


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^[{_BLANK}]+|[{_BLANK}]+$", "")


def answer_letter(response: Column) -> Column:
    """The option letter of a free answer, or null; rules from the first character down to the only letter that occurs."""
    text = F.trim(response)
    upper = F.upper(text)
    found = [F.upper(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit(""))) for p in ANSWER_PATTERNS]
    alone = F.nullif(F.regexp_extract(upper, r"\b([A-D])\b", 1), F.lit(""))
    held = F.filter(F.array(*map(F.lit, LETTERS)), lambda x: upper.contains(x))
    only = F.when(F.size(held) == 1, F.element_at(held, 1))
    first = F.when(F.substring(upper, 1, 1).isin(*LETTERS), F.substring(upper, 1, 1))
    return F.when(F.length(text) > 0, F.coalesce(first, *found, alone, only))


def letter_index(letter: Column) -> Column:
    return F.when(F.length(letter) == 1, F.ascii(letter) - 65).otherwise(F.lit(-1))


def index_letter(index: Column) -> Column:
    return F.char(index + 65)


def is_correct(letter: Column, truth: Column, options: Column) -> Column:
    """Same letter, or the same option text (trimmed, lower case) at both letters; false for a missing letter or truth."""
    text = lambda x: F.lower(F.trim(F.get(options, F.ascii(x) - 65)))
    return F.coalesce((letter == truth) | (text(letter) == text(truth)), F.lit(False)) & F.coalesce(truth != "", F.lit(False)) & letter.isNotNull()


def valid_option(option: Column) -> Column:
    low = F.lower(F.trim(option))
    return F.coalesce((option != "") & (low != "all") & ~low.startswith("unknown"), F.lit(False))


def valid_text(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return ~low.rlike(r"\ball\b") & ~low.contains("unknown")


def question_kept(question: Column, options: Column, answer_index: Column) -> Column:
    low = F.lower(question)
    right = F.lower(F.when((answer_index >= 0) & (answer_index < F.size(options)), F.get(options, answer_index)))
    held = lambda x: F.coalesce(x.contains("all") | x.contains("unknown"), F.lit(False))
    return ~held(low) & ~held(right) & ~F.exists(options, lambda o: F.lower(o).isin("all", "unknown"))


def relabel_plain(options: Column) -> Column:
    strip = lambda o: F.trim(F.ltrim(F.ltrim(F.trim(o), F.lit("ABCD1234")), F.lit(". ")))
    return F.transform(options, lambda o, i: F.concat(F.get(F.array(*map(F.lit, LETTERS)), i), F.lit(". "), strip(o)))


def relabel_kept(options: Column) -> Column:
    letter = lambda i: F.get(F.array(*map(F.lit, LETTERS)), i)
    return F.array_join(F.transform(F.slice(options, 1, 4), lambda o, i: F.when(F.substring(o, 1, 2).isin("A.", "B.", "C.", "D."), o).otherwise(F.concat(letter(i), F.lit(". "), o))), "\n")


def location(header: Column) -> Column:
    return F.trim(F.regexp_extract(header, r"(?i)\[Scene\s*[:\-]?\s*([^\],]+)", 1))


def bad_speaker(name: Column) -> Column:
    out = F.lit(False)
    for word in GROUP_SPEAKERS:
        out = out | name.contains(word)
    return out


def subjects_kept(involved: Column, scene: Column, description: Column) -> Column:
    """The involved subjects that the scene has; if none, the scene's subjects whose name the description holds, in any case."""
    listed = F.filter(involved, lambda x: F.array_contains(scene, F.trim(x)))
    return F.when(F.size(listed) > 0, listed).otherwise(F.filter(scene, lambda x: F.lower(description).contains(F.lower(x))))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


def dialogue_pairs(text: Column) -> Column:
    """array<struct<speaker, text>> of ``Name: words`` lines; a speaker's words reach to the next name."""
    name = r"([A-Za-z][A-Za-z\s.'()/-]{0,30}):"
    names = F.regexp_extract_all(text, F.lit(name), F.lit(1))
    words = F.slice(F.split(text, name), 2, F.size(names))
    pairs = F.transform(F.arrays_zip(names.alias("n"), words.alias("w")), lambda p: F.struct(F.upper(collapse(p["n"])).alias("speaker"), collapse(p["w"]).alias("text")))
    low = lambda p: F.lower(p["speaker"])
    credit = lambda p: F.exists(F.array(*map(F.lit, CREDIT_WORDS)), lambda c: low(p).contains(c))
    return F.filter(pairs, lambda p: ~credit(p) & (F.length(p["speaker"]) <= 30) & (p["text"] != ""))


def alnum_clean(text: Column) -> Column:
    return collapse(F.regexp_replace(text, f"[^a-zA-Z0-9{BLANK}']", ""))


def caption_clean(text: Column, words: int = 50) -> Column:
    """Lower case; a mark, a run of marks and white space, and a line feed at the end are one space each, none at the ends; the first ``words`` words."""
    run = f"{_BLANK}{CAPTION_MARKS}"
    low = F.regexp_replace(F.lower(text), rf"[{run}](?:[{run}]+|(?<=[{CAPTION_MARKS}])|(?<=\n)\z)", " ")
    return F.substring_index(F.trim(low), " ", words)


def punctuation(text: Column) -> Column:
    """A mark goes if the input has it next to a space or holds digit,digit; else it becomes a space. The first 32 full stops that no digit follows go."""
    out, comma = text, text.rlike(r"[0-9],[0-9]")
    for m in MARKS:
        beside = text.contains(m + " ") | text.contains(" " + m) | comma
        out = F.replace(out, F.lit(m), F.when(beside, "").otherwise(" "))
    return F.array_join(F.split(out, r"\.(?![0-9])", 33), "")


def digits_articles(text: Column, contractions: dict[str, str] | None = None) -> Column:
    """Lower case, number words as digits, no articles, contractions with their apostrophes; ``contractions`` replaces the usual table."""
    lookup = lambda table, w: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), w), w)
    words = F.transform(F.split(collapse(F.lower(text)), " "), lambda w: lookup(NUMBER_WORDS, w))
    kept = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(kept, lambda w: lookup(CONTRACTIONS if contractions is None else contractions, w)), " ")


def paragraphs(html: Column) -> Column:
    bodies = F.regexp_extract_all(html, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(bodies, lambda b: collapse(F.regexp_replace(b, r"(?s)<[^>]*>", " "))), lambda b: b != "")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def ordered_distinct(options: Column) -> Column:
    """Valid options, the first spelling of each (trimmed, lower case)."""
    valid = F.filter(options, valid_option)
    key = lambda o: F.lower(F.trim(o))
    return F.filter(valid, lambda o, i: F.array_position(F.transform(valid, key), key(o)) == i + 1)


def join_prompt(parts: Sequence[Column], mark: str = "\n") -> Column:
    return F.concat_ws(mark, *parts)


def padded_id(number: Column, digits: int) -> Column:
    """The number with leading zeros; longer ones stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)


def override(text: Column) -> Column:
    """struct<key, path> of ``key=path``, cut at the first '='; a text without one is a key alone."""
    parts = F.split(text, "=", 2)
    return F.struct(F.get(parts, 0).alias("key"), F.get(parts, 1).alias("path"))
