"""Text functions as column expressions. Java's `(?U)` makes \\w, \\s and \\b Unicode-aware. Repeated groups are possessive: Java runs those in
a loop, while others call themselves once a repetition and end the JVM's stack on long texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that define the results.
REFERENCE_HEADINGS = ("REFERENCES", "REFERENCE", "BIBLIOGRAPHY")
BOILERPLATE = (
    r"\n\s*ACKNOWLEDGMENTS?\s*\n.*?(?=\n\s*[A-Z]{2,}|\z)",
    r"\n\s*Keywords?:.*?\n",
    r"\n\s*CCS CONCEPTS\s*\n.*?(?=\n\s*KEYWORDS|\z)",
    r"\n\s*ACM Reference Format:.*?(?=\n\s*[A-Z]{2,}|\z)",
    r"Permission to make digital.*?(?=\n\s*[A-Z]{2,})",
    r"Copyright.*?ACM\.",
    r"ISBN.*?\n",
    r"DOI:.*?\n",
    r"https?://doi\.org/.*?\n",
)
MAIL = r"\S+@\S+\.(com|edu|org|net|io|ai)"
AFFILIATIONS = (r"(University|Institute|Laboratory|Inc\.|Corp\.|Ltd\.) of \w+", r"\w+ (University|Institute|College|Laboratory)")
MATH = ((r"\b[αβγδεζηθικλμνξοπρστυφχψω]\b", ""), (r"\s+[∈∉⊂⊆∪∩∑∏∫≈≠≤≥]+\s+", " "), (r"Equation\s*\d+", ""), (r"Formula\s*\d+", ""))
BANNERS = (
    r"Preprint\.?\s*Accepted paper at [^.]*\.\s*(?:\d{4} IEEE\.[^.]*\.\s*)?",
    r"arXiv:\d{4}\.\d{4,5}v?\d*\s*\[?[a-z\-]+\.?[A-Z]{2}\]?\s*\d{1,2} [A-Z][a-z]{2} \d{4}\s*",
    r"SUBMITTED TO [A-Z/ ]+\s*\d*\s*",
    r"Contents lists available at ScienceDirect[^A-Z]*",
    r"Future Generation Computer Systems\s*",
    r"ARGONNE NATIONAL LABORATORY[^A-Z]*(?:\d+ South Cass Avenue[^A-Z]*)?",
    r"KSII TRANSACTIONS ON [A-Z ]+VOL\.?\s*\d+[^A-Z]*",
    r"The Nucleus \d+[^a-z]*www\.\S+\s*\d*\s*(?:Pakistan\s*)?(?:The Nucleus\s*)*I?\s*S?\s*",
    r"Title\s+(?=[A-Z])",
)
TITLE_STOP = ["a", "an", "the", "of", "for", "and", "on", "in", "to", "with", "via"]
LINK = r"http[s]?://[a-zA-Z0-9$-_@.&+!*\\(),]++"
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "if", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "what", "when", "where", "which", "with", "why",
]
# End of fixed values.


def sub(c: Column, pattern: str, to: str = "", flags: str = "(?U)") -> Column:
    return F.regexp_replace(c, flags + pattern, to)


def chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: sub(x, *s), steps, c)


def strip(c: Column) -> Column:
    """Without white space at either end (trim() knows spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White-space runs and NULs become one space; ends trimmed."""
    return F.trim(sub(F.translate(c, "\x00", " "), r"\s+", " "))


def cut_references(c: Column) -> Column:
    """Text before the reference heading; the first heading of the list that occurs decides, wherever it stands."""
    at = F.coalesce(*[F.nullif(F.regexp_instr(c, F.lit(rf"(?Ui)\n\s*{h}\s*\n")), F.lit(0)) for h in REFERENCE_HEADINGS])
    return F.when(at.isNull(), c).otherwise(F.substring(c, F.lit(1), at - 1))


def strip_boilerplate(c: Column) -> Column:
    return reduce(lambda x, p: sub(x, p, "\n", "(?Uis)"), BOILERPLATE, c)


def strip_authors(c: Column) -> Column:
    return chain(c, (MAIL, ""), *[(p, "") for p in AFFILIATIONS])


def join_hyphens(c: Column) -> Column:
    return sub(c, r"(\w+)-\s*\n\s*(\w+)", "$1$2")


def strip_math(c: Column) -> Column:
    return chain(c, *MATH)


def strip_tables(c: Column) -> Column:
    return sub(c, r"(?:\|[^\n|]*+\|[^\n]*+\n){2,}+", "\n")


def fix_sentences(c: Column) -> Column:
    return chain(c, (r"\.([A-Z])", ". $1"), (r"[.!?]{2,}", "."), (r"\n{3,}", "\n\n"))


def clean_text(c: Column) -> Column:
    """All cleaning steps in their defined order; later steps can find nothing left to do, and since white space collapses before
    lines are judged, the length and capitals rule sees one line."""
    c = join_hyphens(strip_authors(strip_boilerplate(c)))
    c = chain(c, (r"[^\x00-\x7F]+", " "), (r"[{}()\[\]|@,;]", " "), (r"[.]{2,}", "."), (r"[-]{2,}", "-"), (r"[_]{2,}", "_"))
    c = chain(strip_tables(strip_math(c)), (r"\[[0-9,\-\s]+\]", ""), (LINK, ""), (r"\S+@\S+", ""))
    line = F.trim(sub(fix_sentences(c), r"\s+", " "))
    return F.when(line.isNull() | (F.length(line) > 20) & ~is_upper(line), line).otherwise("")


def is_upper(c: Column) -> Column:
    """Some cased character and none in lower case."""
    return (c == F.upper(c)) & (c != F.lower(c))


def split_marked(c: Column) -> Column:
    """array<struct<name, text>> of the parts after `--- name.pdf ---` marks."""
    marked = F.filter(F.split(c, r"(?=---\s+[^\n]+?\.pdf\s+---)"), lambda x: x.rlike(r"^---\s+.+?\.pdf\s+---"))
    head = r"(?s)^---\s+(.+?\.pdf)\s+---(.*)$"
    return F.transform(marked, lambda x: F.struct(strip(F.regexp_extract(x, head, 1)).alias("name"), strip(F.regexp_extract(x, head, 2)).alias("text")))


def drop_blank_lines(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: F.length(strip(x)) > 0), "\n")


def title_key(c: Column) -> Column:
    return squeeze(sub(F.lower(c), r"[^\w\s]", " "))


def signature(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def quote_key(c: Column) -> Column:
    return F.lower(sub(c, r"\W+", " "))


def prefix_key(c: Column, n: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), 1, n)


def safe_filename(c: Column, most: int = 150) -> Column:
    """Without the characters that file systems forbid, without dots and spaces at the ends, cut at the last space within `most`."""
    x = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', ""), r"^[. ]+|[. ]+$", "")
    x = F.when(F.length(x) > most, F.regexp_replace(F.substring(x, 1, most), r" [^ ]*$", "")).otherwise(x)
    return F.when(F.length(x) == 0, "untitled").otherwise(x)


def slug(c: Column, default: str = "profile") -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(x) == 0, default).otherwise(x)


def token_estimate(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]"), 0))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|[^\w\s]"), 0)


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b\w+\b"), 0))


def space_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: F.length(x) > 0)


def content_tokens(c: Column, least: int = 3, stop: list[str] = STOPWORDS) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w+\b"), 0)
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= least) & ~x.isin(stop)))


def search_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-zA-Z0-9]+"), lambda x: F.length(x) > 1)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: an expression inside a lambda would be computed at each of its steps."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int = 8) -> Column:
    """Strings of n words; none when there are fewer."""

    def cut(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return bound(words, cut)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+(?=[A-Z\(])"), lambda x: strip(x)), lambda x: F.length(x) > 0)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), lambda x: strip(x)), lambda x: F.length(x) > 0)


def head_tokens(c: Column, n: int) -> Column:
    """The text up to the end of its n-th word; all of it when it has no more."""
    return F.when(word_count(c) <= n, c).otherwise(strip(F.regexp_extract(c, rf"(?Us)^(?:\W*+\w++){{{n}}}+", 0)))


def tail_tokens(c: Column, n: int) -> Column:
    """The text from the start of its n-th word from the end; all of it when it has no more."""
    before = F.concat(F.lit(r"(?Us)^(?:\W*+\w++){"), (word_count(c) - n).cast("string"), F.lit(r"}+\W*+"))
    return F.when(word_count(c) <= n, c).otherwise(strip(F.regexp_replace(c, before, F.lit(""))))


def context_prefix(title: Column, section: Column) -> Column:
    return F.concat(F.lit("Paper: '"), title, F.lit("' | Section: "), section)


def length_bucket(n: Column, bounds: tuple[int, ...] = (400, 900, 1600), names: tuple[str, ...] = ("short", "medium", "long", "xlong")) -> Column:
    out = F.lit(names[-1])
    for b, name in reversed(list(zip(bounds, names, strict=False))):
        out = F.when(n < b, name).otherwise(out)
    return out


def cell(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def abstract_from_positions(inv: Column) -> Column:
    """Text of a map word -> positions; null for null, empty for an empty map."""
    pairs = F.flatten(F.transform(F.map_entries(inv), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def last_question(c: Column, is_rag: Column) -> Column:
    return squeeze(F.when(is_rag, F.element_at(F.split(c, "Question:"), -1)).otherwise(c))


def family(name: Column) -> Column:
    x = F.lower(name)
    return F.when(x.contains("qwen"), "qwen").when(x.contains("gemma"), "gemma").otherwise("llama")


# Chat marks of the three families.
CHAT = {
    "llama": ("### System:\n", "### User:\n", "### Assistant:\n", "\n\n"),
    "qwen": ("<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"),
    "gemma": ("", "<start_of_turn>user\n", "<start_of_turn>model\n", "<end_of_turn>\n"),
}
# End of fixed values.


def chat(kind: Column, system: Column, question: Column, response: Column) -> Column:
    """One training text in the family's template; empty when question or response is empty, the system turn only where there is one."""
    s, q, r = (strip(F.coalesce(x, F.lit(""))) for x in (system, question, response))
    out = F.lit("")
    for name, (a, u, m, end) in CHAT.items():
        first = F.when(F.length(s) > 0, F.concat(F.lit(a), s, F.lit(end)) if a else F.lit("")).otherwise("")
        ask = F.concat(s, F.lit("\n\n"), q) if not a else q
        ask = F.when(F.length(s) > 0, ask).otherwise(q)
        out = F.when(kind == name, F.concat(first, F.lit(u), ask, F.lit(end + m), r, F.lit(end.rstrip("\n") if end.strip() else ""))).otherwise(out)
    return F.when((F.length(q) == 0) | (F.length(r) == 0), "").otherwise(out)


def answer(kind: Column, raw: Column) -> Column:
    """The text after the last assistant mark, up to the next turn, without thinking blocks."""
    out = raw
    for name, (_, u, m, end) in CHAT.items():
        stop = end.strip() or u.strip()
        last = F.substring_index(F.substring_index(raw, m.strip(), -1), stop, 1)
        out = F.when(kind == name, last).otherwise(out)
    return strip(F.regexp_replace(out, r"(?s)<think>.*?</think>", ""))


def only_thinks(c: Column, least: int = 15) -> Column:
    x = F.lower(c)
    return x.contains("<think>") & (~x.contains("</think>") | (F.length(strip(F.substring_index(x, "</think>", -1))) < least))


def in_text_ids(c: Column) -> Column:
    head = F.substring(c, 1, 20_000)
    return F.struct(F.nullif(F.regexp_extract(head, r"(?i)\b(10\.\d{4,9}/[-._;()/:a-z0-9]+)", 1), F.lit("")).alias("doi"), F.nullif(F.regexp_extract(head, r"(?i)arxiv:\s*(\d{4}\.\d{4,5})", 1), F.lit("")).alias("arxiv"))


def marked_blocks(c: Column) -> Column:
    """Texts between `PDF_START:` lines and `PDF_END`, stripped, without empty ones; a block without its end goes."""
    blocks = F.filter(F.slice(F.split(c, "PDF_START:"), 2, 2_000_000_000), lambda b: b.contains("PDF_END") & b.contains("\n"))
    body = lambda b: strip(F.regexp_extract(F.substring_index(b, "PDF_END", 1), r"(?s)^[^\n]*\n(.*)$", 1))
    return F.filter(F.transform(blocks, body), lambda x: F.length(x) > 0)


def leading_title(c: Column, most: int = 16) -> Column:
    """A guess at the title: the first words of the head, without a page number and what follows an e-mail mark."""
    head = F.substring(strip(sub(c, r"\s+", " ")), 1, 400)
    head = F.regexp_replace(F.regexp_replace(head, r"^\d+\s+", ""), r"\b[Ee]mail:.*$", "")
    return F.regexp_replace(F.array_join(F.slice(space_words(head), 1, most), " "), r"^[ .,;:-]+|[ .,;:-]+$", "")


def strip_banners(c: Column, passes: int = 4) -> Column:
    """The head of a paper without publishers' banners; banners stack, so the first of each kind goes in each of some passes."""

    def one(x: Column) -> Column:
        for p in BANNERS:
            x = F.regexp_replace(x, rf"(?is)^(.*?)(?:{p})(.*)$", "$1 $2")
        return F.trim(F.regexp_replace(x, r"^\W*\d+\s+", ""))

    out = F.substring(strip(sub(c, r"\s+", " ")), 1, 1500)
    for _ in range(passes):
        out = bound(out, one)
    return squeeze(out)


def title_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda x: (F.length(x) > 2) & ~x.isin(TITLE_STOP)))


def bibliographic_score(guess: Column, title: Column) -> Column:
    """The greater of the Jaccard similarity of title tokens and 0.95 of the share of the title that the guess has; 0 without tokens."""
    g, w = title_tokens(guess), title_tokens(title)
    both = F.size(F.array_intersect(g, w))
    return F.when((F.size(g) > 0) & (F.size(w) > 0), F.greatest(both / F.size(F.array_union(g, w)), both / F.size(w) * 0.95)).otherwise(0.0)


def model_key(path: Column) -> Column:
    """A judged file's model, whoever judged it."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(F.regexp_replace(name, "^hpn_judged_", ""), r"_by_.*\.xlsx$", "")


def benchmark_tag(path: Column, prefix: str = "hpn_qa_benchmark") -> Column:
    """What a benchmark's file name adds to the prefix; empty if nothing."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(stem.startswith(prefix), F.substring(stem, F.lit(len(prefix) + 2), F.length(stem))).otherwise("")
