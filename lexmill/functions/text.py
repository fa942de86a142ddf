"""String functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def _words(names) -> Column:
    return F.array(*[F.lit(x) for x in sorted(names)])


def _in(c: Column, names) -> Column:
    return c.isin(*sorted(names))


def raw_words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case. Lowering comes after the match: some other letters lower to ASCII ones."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: F.lower(w))


def is_token(w: Column) -> Column:
    n = F.length(w)
    return (n <= C.WORD_MOST) & ((n >= C.WORD_LEAST) | ((n == 2) & _in(w, C.SHORT_WORDS)))


def tokens(text: Column) -> Column:
    """The keywords of a text in order, repeated as in the text."""
    return F.filter(raw_words(text), lambda w: is_token(w) & ~_in(w, C.STOP_WORDS))


def bigrams(toks: Column) -> Column:
    """Neighbouring keywords joined by an underscore; long ones are left out."""
    pairs = F.when(F.size(toks) > 1, F.transform(F.sequence(F.lit(1), F.size(toks) - 1), lambda i: F.concat_ws("_", F.element_at(toks, i), F.element_at(toks, i + 1))))
    return F.filter(F.coalesce(pairs, F.array().cast("array<string>")), lambda b: F.length(b) <= C.BIGRAM_MOST_LENGTH)


def token_count(text: Column) -> Column:
    return F.floor(F.octet_length(text) / C.BYTES_PER_TOKEN).cast("long")


def printable(text: Column) -> Column:
    """Line breaks and tabs become spaces; what isn't printable ASCII goes."""
    return F.regexp_replace(F.regexp_replace(text, r"[\n\r\t]", " "), r"[^\x20-\x7E]", "")


def json_safe(text: Column) -> Column:
    """Escaped for JSON: control characters go, each byte beyond ASCII becomes a space (here: each such character)."""
    t = F.regexp_replace(text, r"[^\x00-\x7E]", " ")
    t = F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    t = F.replace(F.replace(F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.regexp_replace(t, r"[\x00-\x1F]", "")


def summary(text: Column) -> Column:
    return F.concat(F.substring(json_safe(F.substring(text, 1, 150)), 1, 100), F.when(F.length(text) > 100, F.lit("...")).otherwise(""))


def snippet(text: Column, size: int = C.SNIPPET_BYTES) -> Column:
    """The whole text if short, else cut at the last space if that leaves at least half; counted in characters."""
    head = F.substring(text, 1, size + 1)
    at = F.length(head) - F.locate(" ", F.reverse(head))  # characters before the last space
    cut = F.when((F.locate(" ", head) > 0) & (at >= size // 2), at).otherwise(size)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, F.lit(1), cut.cast("int")), F.lit("...")))


CHUNK_ID = r"[A-Za-z0-9_]+_(?:DOC|CHAT|CODE|FIX|FEAT)_[0-9]+|[A-Za-z0-9_]+\.[0-9]+|CH[0-9]+"


def chunk_ids(text: Column) -> Column:
    """Chunk ids that a text mentions, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CHUNK_ID), F.lit(0)))


def compression_ratio(ids: Column, context: Column) -> Column:
    size = F.aggregate(ids, F.lit(0), lambda a, x: a + F.length(x) + 2)
    return F.when(F.size(ids) == 0, F.lit(0.0)).otherwise(F.octet_length(context) / F.greatest(size, F.lit(1)))


def is_self_reference(query: Column) -> Column:
    """Whether the first place of any phrase about the speaker is at the start of the query or after a non-letter."""
    q = F.lower(query)

    def test(p: Column) -> Column:
        at = F.instr(q, p)
        return (at > 0) & ((at == 1) | ~F.substr(q, at - 1, F.lit(1)).rlike("[a-z]"))

    return F.exists(F.array(*[F.lit(p) for p in C.SELF_PHRASES]), test)


def with_sources(answer: Column, ids: Column, response_id: Column) -> Column:
    """The answer with the chunks it draws on and its id."""
    sources = F.when(F.size(ids) > 0, F.concat(F.lit("\n\nSources: "), F.array_join(ids, ", "))).otherwise("")
    return F.concat(answer, sources, F.when(response_id.isNotNull(), F.concat(F.lit("\n\nResponse ID: "), response_id)).otherwise(""))


def truncate_context(text: Column, limit: int = C.CONTEXT_CHARS, marker: str = "\n\n[Context truncated due to size limit]") -> Column:
    """Over the limit: cut after the last full stop if that keeps more than four fifths."""
    head = F.substring(text, 1, limit)
    stop = F.length(head) - F.locate(".", F.reverse(head)) + 1
    has = F.locate(".", head) > 0
    cut = F.when(has & (stop - 1 > int(limit * 0.8)), F.substring(text, F.lit(1), stop.cast("int"))).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(marker)))


def judge_verdict(reply: Column) -> Column:
    """A struct of found and terms: FOUND anywhere, or the terms after REFINE:, or else found."""
    refine = F.trim(F.regexp_extract(reply, r"(?s)REFINE:(.*)$", 1))
    refines = reply.contains("REFINE:") & ~reply.contains("FOUND")
    return F.struct((~refines).alias("found"), F.when(refines, refine).otherwise("").alias("terms"))


def decay(timestamp: Column, now: Column) -> Column:
    hours = (now - timestamp) / F.lit(3600.0)
    return F.when(timestamp > 0, C.DECAY_SCORE * F.exp(-hours / C.DECAY_HOURS)).otherwise(F.lit(0.0))


def content_type(name: Column) -> Column:
    code = None
    for ext in (".cpp", ".py", ".js", ".ts", ".go", ".rs"):
        code = name.contains(ext) if code is None else code | name.contains(ext)
    return F.when(code, "CODE").otherwise("DOC")


def type_of_id(chunk_id: Column) -> Column:
    return F.when(chunk_id.startswith("CH"), "CHAT").when(chunk_id.contains("_CODE_"), "CODE").when(chunk_id.contains("_FIX_"), "FIX").when(chunk_id.contains("_FEAT_"), "FEAT").otherwise("DOC")


def chapter_code(name: Column) -> Column:
    """From a file name without its last extension: its letters and digits if digits prevail, else consonants and digits; at most 8."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    digits, letters = F.length(F.regexp_replace(base, "[^0-9]", "")), F.length(F.regexp_replace(base, "[^A-Za-z]", ""))
    code = F.lower(F.when(digits > letters, F.regexp_replace(base, "[^A-Za-z0-9]", "")).otherwise(F.regexp_replace(base, "[^A-Za-z0-9]|[aeiouAEIOU]", "")))
    return F.substring(F.when(code == "", "unk").otherwise(code), 1, 8)


def chat_words(text: Column) -> Column:
    """Words of a conversation: split at white space, stripped to letters and digits, 3 to 20 characters, no stop words."""
    w = F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")))
    return F.filter(w, lambda x: F.length(x).between(3, 20) & ~_in(x, C.STOP_WORDS))
