"""Tokenizer and string functions as Column expressions.

Everything here stays in the JVM.  A text's terms come from its units; a unit
is tokenized on its own, so callers count units first and tokenize each
distinct one, which is what `quarry.operators.index` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: what a unit is, and what joins its segments.
UNIT = r"[\p{L}\p{N}_]+(?:[./-]+[\p{L}\p{N}_]+)*"
SEPARATOR = r"[./-]+"
#: What counts as white space, the same everywhere (Java's \s is ASCII only).
SPACES = "\t\n\x0b\f\r " + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
SPACE = f"[{SPACES}]"
MOST_TOKENS = 20_000

# Function words, kept in the index and ignored in queries.
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "do", "does", "for", "from", "had", "has",
    "have", "how", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "out", "so", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "to", "up", "use", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you",
    "your",
)


def units(text: Column) -> Column:
    """Runs of letters, digits and underscores, joined by dots, slashes and dashes."""
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def segments(unit: Column) -> Column:
    return F.filter(F.split(unit, SEPARATOR), lambda s: s != "")


def is_compound(term: Column) -> Column:
    return F.rlike(term, F.lit(SEPARATOR))


def identifier_parts(segment: Column) -> Column:
    """Lower-case parts of a camelCase, snake_case or lettered-and-numbered name; none if it has but one."""
    spaced = segment
    # Fixed patterns: where a name is cut.
    for pattern in (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    parts = F.filter(F.split(F.lower(spaced), r"[_\s]+"), lambda p: p != "")
    # Bound to a variable, so that the parts are made once.
    return F.get(F.transform(F.array(parts), lambda own: F.when(F.size(own) > 1, own).otherwise(F.array().cast("array<string>"))), 0)


def stem(term: Column) -> Column:
    """The term without an English suffix; null if nothing comes off, fewer than 3 letters stay, or it has a digit."""
    bare = term
    for pattern, to in ((r"^(.{2,})ies$", "$1y"), (r"^(.*[^s])s$", "$1"), (r"^(.{3,})(?:ing|ed)$", "$1"), (r"^(.{4,})e$", "$1")):
        bare = F.regexp_replace(bare, pattern, to)
    # Most terms end in none of the suffixes and need none of the patterns.
    able = F.rlike(term, F.lit("(?:s|ing|ed|e)$")) & (F.length(term) >= 4) & ~F.rlike(term, F.lit("[0-9]"))
    return F.when(able, F.get(F.transform(F.array(bare), lambda own: F.when((F.length(own) >= 3) & (own != term), own)), 0))


#: A unit that is one word: it has neither segments nor parts.
PLAIN = r"^\p{L}[\p{Ll}\p{Lo}\p{Lm}]*$"


def unit_terms(unit: Column) -> Column:
    """Terms of one unit in order: the whole if compound, then of each segment the word, its stem, its parts and theirs."""
    own = segments(unit)
    whole = F.when(F.size(own) > 1, F.array(F.lower(unit))).otherwise(F.array().cast("array<string>"))

    def of(segment: Column) -> Column:
        word = F.lower(segment)
        parts = F.flatten(F.transform(F.filter(identifier_parts(segment), lambda p: p != word), lambda p: F.array(p, stem(p))))
        return F.concat(F.array(word, stem(word)), parts)

    plain = F.array(F.lower(unit), stem(F.lower(unit)))
    return F.filter(F.when(F.rlike(unit, F.lit(PLAIN)), plain).otherwise(F.concat(whole, F.flatten(F.transform(own, of)))), lambda t: t.isNotNull())


def tokenize(text: Column, most: int = MOST_TOKENS) -> Column:
    """Terms of a text in order, cut after `most`."""
    return F.slice(F.flatten(F.transform(units(text), unit_terms)), 1, most)


def collapse(text: Column) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def blank(text: Column) -> Column:
    """Whether there is nothing but white space; null for null."""
    return ~F.rlike(text, F.lit(f"[^{SPACES}]"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def fingerprint(content: Column) -> Column:
    """Identity of near-equal contents: digest of the first 400 characters, lower case, spaces collapsed."""
    return F.sha2(F.substring(collapse(F.lower(content)), 1, 400), 256)


def chunk_id(source: Column, start_line: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, start_line.cast("string"), content), 256), 1, 16)


def approximate_tokens(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def last_section(path: Column) -> Column:
    return F.try_element_at(path, F.lit(-1))
