"""Text functions: search terms, generic code tokens, winnowed fingerprints, annotations, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and their plain forms, as the search index folds them. Fixed values.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Words the generic tokeniser keeps. Fixed values.
KEYWORDS = (
    "if else for while return function func def class const let var new try catch finally throw raise import from export public private "
    "static void int string bool true false null nil None async await match case switch break continue in is not and or fn mut pub impl struct enum type"
).split()


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def terms(text: Column) -> Column:
    """Search terms: folded runs of letters and digits."""
    return F.filter(F.split(F.regexp_replace(fold(text), "[^a-z0-9ß]+", " "), " "), lambda t: t != "")


#: What the generic tokeniser takes for a token: a name, a number, or one other sign. Fixed value.
TOKEN = "([A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_])"


def generic_tokens(source: Column) -> Column:
    """Keywords and punctuation as they are, other names as ID, numbers as NUM."""
    raw = F.regexp_extract_all(source, F.lit(TOKEN), F.lit(1))
    return F.transform(raw, lambda t: F.when(t.isin(*KEYWORDS), t).when(t.rlike("^[A-Za-z_]"), "ID").when(t.rlike("^[0-9]+$"), "NUM").otherwise(t))


def bound(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f looks at it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def structural_hash(tokens: Column) -> Column:
    return F.substring(F.sha2(F.array_join(tokens, " "), 256), 1, 32)


def gram_hashes(tokens: Column, k: int = 5) -> Column:
    """A 60-bit hash of each run of k tokens."""

    def grams(t):
        n = F.size(t)
        at = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice(t, i, k), " ")), 1, 15), 16, 10).cast("long"))

    return bound(tokens, grams)


def winnow(hashes: Column, window: int = 4) -> Column:
    """Sorted set of the window minima; one minimum if there are no more hashes than a window holds."""

    def minima(h):
        n = F.size(h)
        at = F.when(n > window, F.sequence(F.lit(1), n - (window - 1))).otherwise(F.array(F.lit(1)))
        low = F.transform(at, lambda i: F.array_min(F.slice(h, i, window)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(low)))

    return bound(hashes, minima)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def first_sentence(text: Column, most: int = 140) -> Column:
    return F.substring(F.element_at(F.split(F.trim(text), r"(?<=[.!?])\s+", 2), 1), 1, most)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), F.lit("-"))


def id_prefix(spec_id: Column) -> Column:
    """BE-RF-102 to BE-RF."""
    return F.regexp_extract(spec_id, r"^(.+)-[0-9]+$", 1)


def humanise(segment: Column) -> Column:
    """snake_case or kebab-case as words with capitals."""
    return F.initcap(F.trim(F.regexp_replace(segment, "[_-]+", " ")))


def nearest(word: Column, known: list[str], most: int = 2) -> Column:
    """The known word of least edit distance, alphabetical among equals; null beyond ``most``."""
    options = F.array(*(F.struct(F.levenshtein(F.lower(word), F.lit(k)).alias("d"), F.lit(k).alias("k")) for k in sorted(known)))
    best = F.array_min(options)
    return F.when(best["d"] <= most, best["k"])


def java_mapping(annotation: Column) -> Column:
    """method and path of a mapping annotation, ``GET /x``; RequestMapping without a method is ROUTE."""
    verb = F.upper(F.regexp_extract(annotation, r"@(Get|Post|Put|Patch|Delete)Mapping", 1))
    asked = F.regexp_extract(annotation, r"RequestMethod\.([A-Z]+)", 1)
    path = F.regexp_extract(annotation, r"\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"", 1)
    method = F.when(verb != "", verb).when(asked != "", asked).otherwise("ROUTE")
    return F.when(annotation.rlike("@(Get|Post|Put|Patch|Delete|Request)Mapping"), F.concat_ws(" ", method, path))


def type_names(source: Column) -> Column:
    """Capitalised names in a definition, each once."""
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b([A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*)\b"), F.lit(1)))


def raised_names(source: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b(?:raise|throw new|throw)\s+([A-Za-z_][\w.]*)"), F.lit(1)))
