"""Normalisation, answer extraction, tokenising and counting, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCT = r"""!-/:-@\[-`{-~"""  # ASCII punctuation, inside a character class
MARKS = r"\p{L}\p{M}\p{N}_"  # word characters of any script


# ------------------------------------------------------------- normalisation
def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_ends(text: Column) -> Column:
    """Lower case; no punctuation, spaces or newlines at the ends; single spaces within."""
    return collapse(F.regexp_replace(F.lower(text), rf"^[{PUNCT} \n]+|[{PUNCT} \n]+$", ""))


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation, single spaces."""
    return collapse(F.regexp_replace(F.lower(text), rf"[{PUNCT}]", ""))


def normalize_line(text: Column) -> Column:
    """As an answer, and without English articles."""
    return F.array_join(F.filter(F.split(normalize_answer(text), " "), lambda w: ~w.isin("a", "an", "the")), " ")


def normalize_cell(text: Column) -> Column:
    """As a line, without any spaces."""
    return F.replace(normalize_line(text), F.lit(" "), F.lit(""))


# Words that say nothing about a belief.
BELIEF_STOPS = "a an the on in at step thinks think believes believe is are of location know knows belief".split()


def normalize_belief(text: Column) -> Column:
    """Lower case without punctuation, typographic apostrophes and ``BELIEF_STOPS``, single spaces."""
    bare = F.regexp_replace(F.lower(text), rf"[{PUNCT}’]", "")
    return collapse(F.regexp_replace(bare, rf"(?<![{MARKS}])({'|'.join(BELIEF_STOPS)})(?![{MARKS}])", " "))


def list_items(text: Column, by: str = ",") -> Column:
    """Parts of a separated list, lower case, without spaces at the ends."""
    return F.transform(F.split(text, by), lambda x: F.lower(F.trim(x)))


def dashed_lines(text: Column) -> Column:
    """What follows the dash of each line that begins with one, as normalised lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("-"))
    return F.transform(lines, lambda x: normalize_line(F.substring(F.ltrim(x), F.lit(2), F.length(x))))


# ---------------------------------------------------------------- extraction
def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match, null if there is none."""
    return F.element_at(F.nullif(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")), -1)


def quoted(label: str) -> str:
    """A label as a literal part of a pattern."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in label)


def extract_choice(text: Column, labels: dict[str, str], tag: str = "Answer:", none: str = "null") -> Column:
    """The label named after the tag, whatever the case and emphasis; ``labels`` maps what a text names to labels."""
    choice = "|".join(quoted(x) for x in sorted(labels, key=len, reverse=True))
    named = normalize_ends(first_group(text, rf"(?i){quoted(tag)}[\s\*]*({choice})"))
    table = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k.lower(), v)])
    return F.coalesce(table[named], F.lit(none))


def extract_answer(text: Column, tag: str = "Answer:") -> Column:
    """The rest of the line after the tag, without emphasis; the whole text if there is no tag."""
    return F.trim(F.coalesce(first_group(text, rf"{quoted(tag)}[\s`*]*([^\n]*)"), text))


def tagged(text: Column, tag: str) -> Column:
    """From the first opening to the last closing tag; null unless both are there in order."""
    return first_group(text, rf"(?s)<{quoted(tag)}>(.*)</{quoted(tag)}>")


def fenced_code(text: Column) -> Column:
    """The last fenced block."""
    return last_match(text, r"(?s)```[A-Za-z]*\n(.*?)```")


def boxed(text: Column) -> Column:
    """What the last box holds, with braces up to three deep."""
    return last_match(text, r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")


def flat_json(text: Column) -> Column:
    """The last object without objects in it, as text."""
    return last_match(text, r"(\{[^{}]*\})")


def without_reasoning(text: Column, mark: str = "</think>") -> Column:
    """What follows the mark; the whole text if there is none."""
    return F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, -1)).otherwise(text)


def file_timestamp(path: Column) -> Column:
    """The ISO timestamp in a file name, microseconds included."""
    return F.to_timestamp(first_group(path, r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)"))


ARGUMENT = r"^([^=]*)=(?:'*)(.*?)(?:'*)$"


def arguments(text: Column) -> Column:
    """``a=1,b=x`` as a map from names to (kind, value): bool, int, float or string; a comma in a value stays if no name follows it."""

    def entry(part: Column) -> Column:
        value = F.regexp_extract(part, ARGUMENT, 2)
        kind = F.when(value.rlike("(?i)^(true|false)$"), "bool").when(value.rlike("^[0-9]+$"), "int")
        kind = kind.when(value.rlike(r"^-[0-9]+$"), "int").when(value.rlike(r"^-?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?$"), "float").otherwise("string")
        return F.struct(F.regexp_extract(part, ARGUMENT, 1).alias("key"), F.struct(kind.alias("kind"), value.alias("value")).alias("value"))

    parts = F.filter(F.split(F.trim(text), r",(?=\w+=)"), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(F.transform(parts, entry))


def reflection(text: Column, dotall: bool = True) -> Column:
    """What the first reflection tag holds; without ``dotall`` only if it is on one line."""
    return F.trim(first_group(text, ("(?s)" if dotall else "") + r"<reflection>(.*?)</reflection>"))


def extract_label(text: Column, labels: list[str], tag: str = "Answer:") -> Column:
    """The label right after the tag, case as it is; the whole text where there is none."""
    choice = "|".join(quoted(x) for x in sorted(labels, key=len, reverse=True))
    return F.trim(F.coalesce(first_group(text, rf"{quoted(tag)}[\s\r\n`*]*({choice})"), text))


def repaired_json(text: Column, field: str) -> Column:
    """The last flat object as a variant, if need be with the escaped quotes of one field's name undone; null if that is no JSON either."""
    found = flat_json(text)
    return F.coalesce(F.try_parse_json(found), F.try_parse_json(F.replace(found, F.lit(f'\\"{field}\\"'), F.lit(f'"{field}"'))))


def with_answer_pattern(text: Column, tag: str, pattern: str, whole: bool = True) -> Column:
    """Group 1 of a tag followed by a pattern; else the whole text, or null if not ``whole``; no white space at the ends."""
    found = F.nullif(first_group(text, quoted(tag) + pattern), F.lit(""))
    return F.regexp_replace(F.coalesce(found, text) if whole else found, r"^\s+|\s+$", "")


# ------------------------------------------------------------------ tokenising
def tokens(text: Column) -> Column:
    """Lower case, split at white space, ASCII symbols and punctuation of any script; control characters vanish, no empty tokens."""
    clean = F.regexp_replace(F.lower(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}\p{Co}\x{FFFD}]", "")
    spaced = F.regexp_replace(clean, rf"[{PUNCT}\p{{P}}\s\p{{Z}}]+", " ")
    return F.filter(F.split(spaced, " "), lambda x: x != "")


def spaced_ideographs(text: Column) -> Column:
    """A space on both sides of every ideograph."""
    return F.regexp_replace(text, r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}])", " $1 ")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda x: F.trim(x) != "")


def sentences(text: Column) -> Column:
    """Cut after a full stop, question or exclamation mark before white space."""
    marked = F.regexp_replace(text, r"([.?!]+)\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda x: F.trim(x) != "")


TAIL = 32  # characters that a decision looks at on either side: more than any abbreviation, and than the letters with full stops of AROUND pieces
BLANK, SOLID = r"[\x09-\x0D\x20]", r"[^\x09-\x0D\x20]"

# Marks that end a sentence by language, what may close it after them, and abbreviations before marks.
ENDINGS = {"zh": "｡。！？", "my": "။.!?"}
CLOSING = r"""\)\]\}'"”’»」』）\*_"""
ABBREVIATIONS = "[a-z]|Mr|Dr|Ms|Sr|Jr|Co|vs|Lt|St|Rd|i.e|e.g|a.m|p.m|M.A|Mrs|Inc|Ltd|etc|Rev|Hon|Gen|Sgt|Rep|Sen|Ave|Col|Ph.D|Prof|Capt|Blvd|Corp"
ABBREVIATED = rf"(?:^|[^A-Za-z0-9_])(?:{ABBREVIATIONS.replace('.', chr(92) + '.')})\.$"


def ending_marks(language: str, colons: bool = False, semicolons: bool = False) -> str:
    wide = language == "zh"
    return ENDINGS.get(language, ".!?") + (("：" if wide else ":") if colons else "") + (("；" if wide else ";") if semicolons else "")


def language_sentences(text: Column, language: str = "en", colons: bool = False, semicolons: bool = False) -> Column:
    """Sentences of each line, for a language's marks: a word that ends with marks, closed quotes and brackets aside, is the last of its sentence.

    A single mark after a digit, or after an abbreviation with its full stop, ends
    none. What has neither letter nor digit is left out.
    """
    marks = ending_marks(language, colons, semicolons)

    def last(piece: Column) -> Column:
        """Whether a piece of a line ends a sentence."""
        bare = F.regexp_replace(piece, rf"[{marks}][{CLOSING}]*\z", "")
        return piece.rlike(rf"[{marks}][{CLOSING}]*\z") & let(F.right(bare, F.lit(TAIL)), lambda b: b.rlike(rf"[{marks}]\z") | ~(b.rlike(r"\p{Nd}\z") | b.rlike(ABBREVIATED)))

    def folded(line: Column) -> Column:
        # pieces that end with a word which ends with a mark, and what is left
        pieces = F.regexp_extract_all(line, F.lit(rf"(?s)(.*?[{marks}][{CLOSING}]*(?!{SOLID})|.+\z)"))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(state: Column, piece: Column) -> Column:
            whole = F.concat(state["open"], piece)
            done = F.struct(F.concat(state["done"], F.array(whole)).alias("done"), F.lit("").alias("open"))
            return F.when(last(piece), done).otherwise(F.struct(state["done"].alias("done"), whole.alias("open")))

        return F.aggregate(pieces, start, step, lambda state: F.concat(state["done"], F.array(state["open"])))

    parts = F.flatten(F.transform(F.split(text, r"[\r\n|]"), folded))
    bare = F.transform(parts, lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.filter(bare, lambda x: x.rlike(r"[^\p{P}\p{S}\s]"))


# Words whose full stop ends no sentence, words that begin one, and ends of names of web sites.
TITLES, SUFFIXES = "Mr|St|Mrs|Ms|Dr", "Inc|Ltd|Jr|Sr|Co"
STARTERS = r"(?:Mr|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|He\s|She\s|It\s|They\s|Their\s|Our\s|We\s|But\s|However\s|That\s|This\s|Wherever)"
SITES = "com|net|org|io|gov|edu|me"
AROUND = 9  # pieces between marks that a decision looks at on either side




def stop_ends(left: Column, right: Column) -> Column:
    """Whether the full stop at the end of ``left``, before ``right``, ends a sentence; the first case that holds decides."""
    letters = lambda text, pattern: (F.length(F.regexp_extract(text, pattern, 1)) / 2).cast("int")
    apart = F.regexp_replace(left, rf"(?:{TITLES})\.", "-")  # their last letters are in no acronym
    counts = F.struct(letters(apart, r"((?:[A-Za-z]\.)+)$").alias("before"), letters(right, r"^((?:[A-Za-z]\.)+)").alias("after"))
    begins = right.rlike(f"^ {STARTERS}")
    return (
        F.when(left.rlike(rf"(?:{TITLES})\.$") | right.rlike(f"^(?:{SITES})"), False)
        .when(left.rlike(r"[0-9]\.$") & right.rlike("^[0-9]"), False)
        .when(right.startswith("."), False)
        .when(left.endswith(".."), True)  # the last of a run
        .when((left.endswith("Ph.") & right.startswith("D.")) | left.endswith("Ph.D."), False)
        .when(left.rlike(r"[A-Z]\.[A-Z]\.$") & begins, True)  # an acronym, and a new sentence
        # within letters with full stops each; at their end they go by threes and twos, and one that is left over counts as a word
        .when(left.rlike(r"[A-Za-z]\.$") & let(counts, lambda c: ((c["before"] > 0) & (c["after"] > 0)) | ((c["before"] > 1) & ((c["before"] + c["after"]) % 3 != 1))), False)
        .when(left.rlike(rf" (?:{SUFFIXES})\.$"), begins)
        .otherwise(~left.rlike(r"\s[A-Za-z]\.$"))  # an initial
    )


def english_sentences(text: Column) -> Column:
    """Cut after ``.``, ``?`` and ``!``, but for full stops in titles, initials, acronyms, decimals, web sites and runs of dots.

    The text falls into pieces that end with a mark each. Every mark is decided by
    the pieces round it, and one fold joins what stays together. A quote that
    closes right after a mark comes before the mark; a company's suffix that ends a
    sentence gives up its full stop.
    """
    padded = F.concat(F.lit(" "), F.regexp_replace(text, "\n", " "), F.lit("  "))

    def decided(pieces: Column) -> Column:
        """Pieces with whether their mark ends a sentence, and whether the quote that follows moves before it."""

        def each(sides: Column) -> Column:
            piece, left, right = sides["piece"], sides["left"], sides["right"]
            stop = piece.endswith(".")
            # after a run of dots a quote stays where it is
            moves = F.when(stop, right.rlike('^["”]') & ~left.endswith("..")).otherwise(right.startswith('"'))
            return let(F.when(stop, stop_ends(left, right)).otherwise(piece.rlike("[?!]$")), lambda e: F.struct(F.when(stop & e & left.rlike(rf" (?:{SUFFIXES})\.$"), F.rtrim(piece, F.lit("."))).otherwise(piece).alias("piece"), e.alias("ends"), (e & moves).alias("moves"), F.substring(right, 1, 1).alias("next")))

        def beside(piece: Column, i: Column) -> Column:
            """A piece with the characters up to its end, and with those after it."""
            first = F.greatest(i - (AROUND - 1), F.lit(0))
            left, right = F.array_join(F.slice(pieces, first + 1, i - first + 1), ""), F.array_join(F.slice(pieces, i + 2, AROUND), "")
            return F.struct(piece.alias("piece"), F.right(left, F.lit(TAIL)).alias("left"), F.left(right, F.lit(TAIL)).alias("right"))

        return F.transform(F.transform(pieces, beside), each)

    def step(state: Column, x: Column) -> Column:
        own = F.when(state["moved"], F.substring(x["piece"], 2, 1 << 30)).otherwise(x["piece"])
        whole = F.concat(state["open"], own)
        cut = F.when(x["moves"], F.concat(F.left(whole, F.length(whole) - 1), x["next"], F.right(whole, F.lit(1)))).otherwise(whole)
        done = F.when(x["ends"], F.concat(state["done"], F.array(cut))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(x["ends"], "").otherwise(whole).alias("open"), x["moves"].alias("moved"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("moved"))
    pieces = F.regexp_extract_all(padded, F.lit(r"([^.?!]*[.?!]|[^.?!]+$)"))
    parts = let(pieces, lambda p: F.aggregate(decided(p), start, step, lambda state: F.concat(state["done"], F.array(state["open"]))))
    bare = F.transform(parts, lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", ""))
    return let(bare, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[{MARKS}]+"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once, even where lambdas inside name it at every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(size: Column, n: int, make: Callable[[Column], Column]) -> Column:
    """make(i) for every start i of n places among ``size``, from 1."""
    at = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, make)


def ngrams(items: Column, n: int) -> Column:
    """Joined runs of n items; none if there are fewer."""
    if n == 1:
        return items
    return let(items, lambda x: runs(F.size(x), n, lambda i: F.array_join(F.slice(x, i, n), " ")))


def hashed_ngrams(items: Column, n: int) -> Column:
    """64-bit hashes of all runs of n items."""
    if n == 1:
        return F.transform(items, lambda x: F.xxhash64(x))
    return let(items, lambda x: runs(F.size(x), n, lambda i: F.xxhash64(F.slice(x, i, n))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def norm(score: Column, low: Column | float, high: Column | float) -> Column:
    """max((score - low) / (high - low), 0), 0 where both ends are the same; not clamped above."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.greatest(ratio(score - low, high - low), F.lit(0.0))


def f_measure(p: Column, r: Column, beta: float = 1.0) -> Column:
    return ratio((1 + beta**2) * p * r, beta**2 * p + r)
