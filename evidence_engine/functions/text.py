"""Text as column expressions: tokens, stems, terms, sentences, citations, windows, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

# The token pattern, the stop words and the ordered suffixes of the stemmer.
TOKEN = "[a-z0-9]+(?:'[a-z]+)?"
STOPWORDS = tuple(
    """
a an and are as at be been but by can could did do does for from had has have
he her his how i if in into is it its me my no nor not of on or our out over
she should so than that the their them then there these they this those to
too under until up was we were what when where which while who whom why will
with would you your about above after again against all also am any because
before being below between both during each few further here more most other
same some such only own s t just don now
""".split()
)
SUFFIXES = (("ies", "y"), ("es", ""), ("s", ""), ("ing", ""), ("ed", ""))
CITATION = r"\[([A-Za-z]{1,2}\d{1,3}(?:\s*,\s*[A-Za-z]{1,2}\d{1,3})*)\]"
SENTENCE = r"""(?<=[.!?])\s+(?=[A-Z"'])|(?<=\])\s+(?=[A-Z"'])|\n+"""
TWO_LEVEL = ("co.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.in", "com.br", "co.za")


def tokenize(text):
    """Lower-case word tokens; null text gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stem(token):
    """The first suffix that fits a token of more than its length plus 3 is cut; ies becomes y."""
    out = token
    for suffix, put in reversed(SUFFIXES):
        cut = F.concat(F.substring(token, F.lit(1), F.char_length(token) - len(suffix)), F.lit(put))
        out = F.when((F.char_length(token) > len(suffix) + 3) & token.endswith(suffix), cut).otherwise(out)
    return out


def analyze(text):
    """Stemmed tokens without stop words, in order, repeats kept."""
    return F.transform(F.filter(tokenize(text), lambda t: ~t.isin(*STOPWORDS)), stem)


def content_terms(text):
    """Distinct analysed terms of more than two characters that aren't stop words."""
    return F.array_distinct(F.filter(analyze(text), lambda t: ~t.isin(*STOPWORDS) & (F.char_length(t) > 2)))


def clean(text):
    """LF line ends, words joined over a hyphen at a line end, single blanks, at most one empty line."""
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?U)(\w)-\n(\w)", "$1$2")
    lines = F.transform(F.split(F.regexp_replace(text, "[ \t\xa0]+", " "), "\n"), lambda x: F.trim(x))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def token_count(text):
    """Estimated model tokens: a quarter of the characters, at least 1; 0 for no text."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def token_windows(text, size, overlap):
    """Windows of 4 * size characters with a stride of 4 * (size - overlap); blank ones left out."""
    text = F.coalesce(text, F.lit(""))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)), F.lit(4 * (size - overlap)))
    return F.filter(F.transform(starts, lambda i: F.substring(text, i, F.lit(4 * size))), lambda w: F.trim(w) != "")


def sentences(text):
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE), lambda s: F.trim(s)), lambda s: s != "")


def citations(text):
    """Ids of inline citations such as [S1] or [S1, W2], upper-cased, in order."""
    return F.transform(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)), lambda x: F.split(x, r"\s*,\s*"))), lambda x: F.upper(F.trim(x)))


def citation_key(name):
    """The form in which cited and known ids are compared."""
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"^[\[\]()<>.,;\s]+|[\[\]()<>.,;\s]+$", ""))


def jaccard(a, b):
    """Share of common elements; 0 only where both are empty or nothing is shared."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def host(url):
    """Host of a URL in lower case without a leading www."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), r"^www\.", "")


def registrable_domain(url):
    """The last two labels of the host, three below a two-level public suffix."""
    labels = F.split(host(url), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(two.isin(*TWO_LEVEL), three).otherwise(two)


def truncate_tokens(text, limit):
    """At most so many estimated tokens of a text; nothing for a limit of 0 or less. limit: a number or a column."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(limit <= 0, "").otherwise(F.substring(text, F.lit(1), (limit * 4).cast("int")))


def fits(text, budget, used=0):
    return token_count(text) + used <= budget


def truncate_page(text, limit: int):
    """A struct of kept text, kept and total characters: at most `limit`, cut at the last paragraph break of its last tenth if
    there is one."""
    text = F.coalesce(text, F.lit(""))
    total, low = F.char_length(text), int(limit * 0.9)
    tail = F.substring(text, low + 1, limit - low)
    # The last break in the tail: what follows it holds none.
    after = F.substring_index(tail, "\n\n", -1)
    at = F.when(F.contains(tail, F.lit("\n\n")), low + F.char_length(tail) - F.char_length(after) - 2).otherwise(0)
    cut = F.when(total <= limit, total).when(at > 0, at).otherwise(limit)
    return F.struct(F.substring(text, F.lit(1), cut.cast("int")).alias("text"), cut.cast("long").alias("kept"), total.cast("long").alias("total"), (total > limit).alias("truncated"))


# The entities of HTML that are decoded without Python; the rest is left to html_text().
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip_html(fragment):
    """A fragment's text: tags out, common entities decoded, white space single."""
    out = F.regexp_replace(F.coalesce(fragment, F.lit("")), r"<[^>]+>", " ")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# Quoted strings, runs of capitalised words, measures, and words that only start a sentence.
QUOTED = "[\"“']([^\"”']{3,60})[\"”']"
PROPER = r"\b[A-Z][\w'-]*(?:\s+(?:of|de|van|der|and|for|the)\s+[A-Z][\w'-]*|\s+[A-Z][\w'-]*)*"
MEASURE = r"(?i)\b\d[\d,.]*\s?(?:%|percent\b|million\b|billion\b|bn\b|m\b|k\b)"
STARTERS = tuple("the this that these those it he she they there here a an in on at for and but his her their its we you i our your".split())


def salient_terms(claims, limit: int = 6):
    """Entities of an array of claims for a follow-up query: quoted strings, runs of proper nouns and measures of each claim, in
    that order, each once whatever its case. A word that merely starts a sentence is taken off the run."""
    none = F.array().cast("array<string>")

    def runs(sentence):
        def one(m, i):
            first = F.lower(F.substring_index(F.regexp_replace(m, r"\s+", " "), " ", 1))
            rest = F.when(m.contains(" "), F.regexp_replace(m, r"^\S+ ", "")).otherwise("")
            return F.when((i == 0) & sentence.startswith(m) & first.isin(*STARTERS), rest).otherwise(m)

        return F.transform(F.regexp_extract_all(sentence, F.lit(PROPER), F.lit(0)), one)

    def of_claim(text):
        pieces = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x))
        return F.concat(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), F.flatten(F.transform(pieces, runs)), F.regexp_extract_all(text, F.lit(MEASURE), F.lit(0)))

    found = F.transform(F.flatten(F.transform(F.coalesce(claims, none), lambda t: of_claim(F.coalesce(t, F.lit(""))))), lambda x: F.regexp_replace(x, r"^[ .,;:]+|[ .,;:]+$", ""))
    kept = F.aggregate(F.filter(found, lambda x: F.char_length(x) > 2), none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    return F.slice(kept, 1, limit)
