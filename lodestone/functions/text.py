"""String functions as Column expressions: trigrams, edit distance, identifiers, tokens, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that entity extraction leaves out.
STOP_WORDS = "the a an and or but in on at to for of with by from how what where when why who use using used get set do does is are was were be been".split()
# What counts as a code identifier, in order of search.
IDENTIFIER_PATTERNS = [
    "[A-Z][A-Za-z0-9]*([A-Z][a-z0-9]+)*",
    "[a-z0-9]+(?:[_][a-z0-9]+)+",
    "[a-z0-9]+(?:[-][a-z0-9]+)+",
    "[A-Z0-9]+(?:[_][A-Z0-9]+)+",
    "(?i)[@a-z0-9]+(?:[/.][a-z0-9-]+)+",
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text: Column | str) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(_c(text), "(?U)^\\s+|\\s+$", "")


def trigrams(text: Column | str) -> Column:
    """Distinct three-character windows of the text padded by two spaces before and one after; a shorter text is its own."""
    t = _c(text)
    padded = F.concat(F.lit("  "), t, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(t) + 1), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(t) < 3, F.array(t)).otherwise(F.array_distinct(grams))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance without regard to case."""
    return F.levenshtein(F.lower(_c(a)), F.lower(_c(b)))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - distance / longer length; 1.0 for two empty texts."""
    longer = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - edit_distance(a, b) / longer)


def trigram_jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = trigrams(F.lower(_c(a))), trigrams(F.lower(_c(b)))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def fuzzy_match(text: Column | str, pattern: Column | str, threshold: float = 0.7) -> Column:
    """The pattern lies in the text (in any case), or their trigrams are similar enough."""
    return F.lower(_c(text)).contains(F.lower(_c(pattern))) | (trigram_jaccard(text, pattern) >= threshold)


def identifiers(text: Column | str) -> Column:
    """Distinct code identifiers: CamelCase, snake_case, kebab-case, UPPER_CASE, dotted or scoped."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(_c(text), F.lit(p), 0) for p in IDENTIFIER_PATTERNS]))


def normalize_identifier(text: Column | str) -> Column:
    return trimmed(F.regexp_replace(F.lower(_c(text)), "[-_./@\\\\]", ""))


def identifiers_similar(a: Column | str, b: Column | str) -> Column:
    return normalize_identifier(a) == normalize_identifier(b)


def query_entities(query: Column | str, strip: bool = True) -> Column:
    """Distinct words of a query that may name entities: longer than two characters and no stop words."""
    bare = lambda w: F.regexp_replace(w, "[^A-Za-z0-9_]", "")
    words = F.filter(F.split(F.lower(_c(query)), "\\s+"), lambda w: (F.length(bare(w)) > 2) & ~bare(w).isin(STOP_WORDS))
    return F.array_distinct(F.transform(words, bare) if strip else words)


def normalize_entity(text: Column | str) -> Column:
    return F.lower(trimmed(text))


def sanitize_relationship(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(trimmed(text)), "\\W+", "_")


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(_c(text)), "[^\\p{L}\\p{N}]+"), "")


def like_anywhere(text: Column | str, pattern: str) -> Column:
    """Substring match in any case; % and _ in the pattern are wildcards, a backslash is itself."""
    return F.lower(_c(text)).like("%" + pattern.lower().replace("\\", "\\\\") + "%")


def window_edit_distance(text: Column | str, pattern: str) -> Column:
    """Least edit distance of the pattern to any window of its length; null if the text is shorter."""
    n, t = len(pattern), F.lower(_c(text))
    windows = F.transform(
        F.sequence(F.lit(1), F.length(t) - (n - 1)),
        lambda i: F.levenshtein(F.substring(t, i, F.lit(n)), F.lit(pattern.lower())),
    )
    return F.when(F.length(t) >= n, F.array_min(windows))


def token_estimate(*parts: Column) -> Column:
    """Four characters a token, rounded up once over all parts (an aggregate)."""
    return F.ceil(F.coalesce(F.sum(sum((F.length(p) for p in parts[1:]), F.length(parts[0]))), F.lit(0)) / 4)


def extraction_counts(text: Column | str) -> tuple[Column, Column]:
    """Entities and relationships that a model's output says it found."""
    return F.regexp_count(_c(text), F.lit("Entity:\\s*[^\n]+")), F.regexp_count(_c(text), F.lit("Parsed relationship:"))
