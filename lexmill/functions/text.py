"""Text functions as Spark columns; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import STOP_WORDS

_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x2EBF0, 0x2EE5F), (0x30000, 0x3134F), (0x31350, 0x323AF), (0x2F800, 0x2FA1F))
CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _RANGES)
WORD = "[A-Za-z0-9_]{2,}"
#: Line ends of universal splitting; a closing one ends the last line.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: White space of Python's str.strip().
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


_BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bound(value: Column, function) -> Column:
    """``function`` of a value that is computed once, however often the function uses it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+$", "")


def lines(text: Column) -> Column:
    """Lines under universal line ends; an empty text has none."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_cjk(char: Column) -> Column:
    return char.rlike(f"^[{CJK}]$")


def _run_tokens(run: Column) -> Column:
    """Tokens of one CJK run: the run itself if it has 2 to 6 characters, then its 2-, 3- and 4-grams, each once."""
    n = F.length(run)

    def grams(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(run, i, F.lit(k)))

    whole = F.when(n <= 6, F.array(run)).otherwise(F.array().cast("array<string>"))
    return F.when(n == 1, F.array(run)).otherwise(F.array_distinct(F.concat(whole, grams(2), grams(3), grams(4))))


def cjk_ngrams(text: Column) -> Column:
    """Tokens of all CJK runs, run after run."""
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    return F.when(text.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, _run_tokens))).otherwise(F.array().cast("array<string>"))


def without_stop_words(tokens: Column) -> Column:
    """Repeats stay; membership is tested against a hash set."""
    return F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS))


def ascii_words(text: Column) -> Column:
    """Lower-case ASCII words of two or more characters.

    The text is lowered once, before the split; the two characters that would turn into ASCII letters are
    taken out first.
    """
    lowered = F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")), F.lit("\u0130"), F.lit("\ufffd")))
    return F.regexp_extract_all(lowered, F.lit("[a-z0-9_]{2,}"), F.lit(0))


def search_tokens(text: Column) -> Column:
    """CJK tokens, then lower-case ASCII words of two or more characters, without stop words.

    Full-width punctuation parts tokens just as half-width punctuation does.
    """
    words = ascii_words(text)
    return without_stop_words(F.when(text.rlike(f"[{CJK}]"), F.concat(cjk_ngrams(text), words)).otherwise(words))


def index_text(text: Column) -> Column:
    """The searchable form of a text: its tokens joined by blanks."""
    return F.array_join(search_tokens(text), " ")


def index_tokens(text: Column) -> Column:
    """What the index counts: tokens, split at underscores."""
    whole = search_tokens(text)
    split = F.filter(F.flatten(F.transform(whole, lambda t: F.split(t, "_"))), lambda t: t != "")
    return F.when(F.contains(text, F.lit("_")), split).otherwise(whole)


def markdown_to_plain(text: Column) -> Column:
    """Lines stripped of heading marks, code ticks, link targets and emphasis; one closing line end."""

    def plain(line: Column) -> Column:
        s = F.regexp_replace(strip(line), r"^#{1,6}\s+", "")
        s = F.regexp_replace(s, "`([^`]*)`", "$1")
        s = F.regexp_replace(s, r"\[(.*?)\]\((.*?)\)", "[$1]")
        return F.replace(F.replace(F.replace(s, F.lit("**"), F.lit("")), F.lit("__"), F.lit("")), F.lit("*"), F.lit(""))

    return F.concat(strip(F.array_join(F.transform(lines(text), plain), "\n")), F.lit("\n"))


def canonical_line_ends(text: Column) -> Column:
    """Line feeds alone, and one at the end."""
    s = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when(s.endswith("\n"), s).otherwise(F.concat(s, F.lit("\n")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def legacy_hash(text: Column) -> Column:
    return F.sha1(text)


def _json_string(text: Column) -> Column:
    """The JSON literal of a text, with the quotes."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"^\{\"x\":(.*)\}$", 1)


def span_id(doc_id: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("["), _json_string(doc_id), F.lit(", "), start.cast("string"), F.lit(", "), end.cast("string"), F.lit("]")), 256), 1, 16)


def node_key(node_id: Column, version: Column) -> Column:
    return F.concat(node_id, F.lit("@"), version)


def has_front_matter(text: Column) -> Column:
    return text.startswith("---") & (F.size(F.split(text, "---", 3)) == 3)


def strip_front_matter(text: Column) -> Column:
    """The part behind the second ``---``, without leading line ends."""
    return F.when(has_front_matter(text), F.regexp_replace(F.get(F.split(text, "---", 3), F.lit(2)), r"^[\r\n]+", "")).otherwise(text)


def front_matter(text: Column) -> Column:
    """map<string,string> of ``key: value`` lines between the first two ``---``; the last of equal keys counts."""
    pairs = F.filter(lines(F.get(F.split(text, "---", 3), F.lit(1))), lambda x: x.contains(":"))

    def entry(line: Column) -> Column:
        value = F.regexp_replace(strip(F.regexp_replace(line, r"^[^:]*:", "")), '^"+|"+$', "")
        return F.struct(strip(F.regexp_extract(line, r"^([^:]*):", 1)).alias("key"), value.alias("value"))

    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(has_front_matter(text), F.map_from_entries(last)).otherwise(empty)


def source_version(name: Column, title: Column) -> Column:
    """``v<n>`` of the first V-number in the title, else in the name, else ``current``."""
    pattern = r"(?i)\bv(\d+)\b"
    found = F.coalesce(F.nullif(F.regexp_extract(title, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")))
    return F.coalesce(F.concat(F.lit("v"), found), F.lit("current"))


def alias_form(text: Column) -> Column:
    """Lower case, only ASCII letters, digits and CJK; the text must be in form NFKC already (see udf.nfkc)."""
    return F.regexp_replace(F.lower(text), f"[^0-9a-z{CJK}]+", "")


def tidy_title(text: Column) -> Column:
    """White space collapsed; none between CJK characters."""
    s = strip(F.regexp_replace(text, rf"{SPACE}+", " "))
    han = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
    return F.regexp_replace(s, rf"(?<={han}) (?={han})", "")


def document_title(text: Column, stem: Column) -> Column:
    """The heading text if the first line that is not blank is a heading, else the stem."""
    head = F.ltrim(text, F.lit(_BLANKS))
    first = strip(F.regexp_extract(head, r"^([^\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]*)", 1))
    heading = tidy_title(F.regexp_replace(first, r"^#{1,6}\s+", ""))
    # most texts stop at the test for a mark, which copies nothing
    return F.when(head.startswith("#"), F.coalesce(F.nullif(heading, F.lit("")), stem)).otherwise(stem)


def title_keywords(title: Column) -> Column:
    parts = F.split(strip(title), r"[\s、/，,；;：:（）()《》'\-]+|与|及|和|以及")
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda p: F.length(p) >= 2))


def query_terms(text: Column) -> Column:
    return F.filter(F.split(strip(text), rf"{SPACE}+"), lambda t: t != "")


def count_occurrences(text: Column, needle: Column) -> Column:
    """Occurrences that do not overlap; 0 for an empty needle."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("int")).otherwise(F.lit(0))


def window_around(text: Column, terms: Column, size: int) -> Column:
    """``size`` characters around the first occurrence of any term; the start of the text if there is none."""
    places = F.filter(F.transform(F.filter(terms, lambda t: t != ""), lambda t: F.instr(text, t)), lambda p: p > 0)
    at, n = F.array_min(places) - 1, F.length(text)
    wanted = F.greatest(F.lit(0), at - size // 3)
    end = F.least(n, wanted + size)
    start = F.when(end - wanted < size, F.greatest(F.lit(0), end - size)).otherwise(wanted)
    cut = F.concat(F.when(start > 0, "… ").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, " …").otherwise(""))
    return F.when(F.lit(size <= 0), F.lit("")).when(F.size(places) == 0, F.substring(text, 1, size)).otherwise(cut)


def inline_markdown(text: Column) -> Column:
    """Safe inside back ticks and on one line."""
    return F.translate(text, "`\n", "' ")


def file_index(node_id: Column, ordinal: Column) -> Column:
    digits = F.regexp_extract(node_id, r"(\d+)$", 1)
    return F.when(ordinal > 0, ordinal.cast("long")).otherwise(F.coalesce(F.nullif(digits, F.lit("")).cast("long"), F.lit(0)))


def parse_flag(value: Column, default: bool = True) -> Column:
    """Of text: true, 1, yes, on; null is the default, everything else false."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("true", "1", "yes", "on"), F.lit(default))


def safe_version(version: Column) -> Column:
    """A version as part of a file name."""
    s = F.regexp_replace(F.regexp_replace(version, r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("current"))


def tolerant_pattern(literal: str) -> str:
    """A regular expression for the literal, in which full- and half-width punctuation are alike."""
    pairs = dict(zip(",.:;?!", "，。：；？！"))
    pairs |= {wide: narrow for narrow, wide in pairs.items()}
    return "".join(f"[{c}{pairs[c]}]" if c in pairs else f"\\{c}" if c in r".^$*+?{}[]\|()" else c for c in literal)


def glob_pattern(glob: Column) -> Column:
    """The regular expression of a case-sensitive shell pattern with * and ? and character sets; an unclosed [ is itself."""

    def one(x: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(F.substring(x, 2, 1 << 30), r"\]$", ""), r"([\\\[\]&^~])", r"\\$1")
        chosen = F.concat(F.lit("["), F.regexp_replace(body, "^!", "^"), F.lit("]"))
        return F.when(x == "*", ".*").when(x == "?", ".").when(F.length(x) > 1, chosen).otherwise(F.regexp_replace(x, r"([^A-Za-z0-9_])", r"\\$1"))

    parts = F.regexp_extract_all(glob, F.lit(r"(?s)\[!?\]?[^\]]*\]|."), F.lit(0))
    return F.concat(F.lit("^(?s:"), F.array_join(F.transform(parts, one), ""), F.lit(")$"))


_NAME = r"[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?"


def valid_name(name: Column) -> Column:
    """Whether a knowledge base may have the name: lower-case letters and digits, in parts joined by single hyphens, at most 64."""
    return name.rlike(f"^{_NAME}$") & ~F.contains(name, F.lit("--"))


def leaf_text(plain: Column, markdown: Column) -> Column:
    """Searchable text of a node: its plain body, else its Markdown made plain, else nothing."""
    return F.coalesce(F.when(strip(plain) != "", plain), F.when(strip(markdown) != "", markdown_to_plain(markdown)), F.lit(""))
