"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple(
    "a an and are as at be but by else for from has he i if in is it its me my not of on or our that the their them then these they this those to us was we were will with you your".split()
)
CONTROL_WORDS = ("if", "else", "elif", "for", "while", "try", "except", "finally", "with", "return", "yield", "await")
TYPE_WORDS = ("str", "int", "float", "bool", "list", "dict", "set", "tuple", "optional", "any", "none")

_HUMP = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def _kept(tokens: Column, shortest: int = 1) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= shortest) & ~t.isin(*STOPWORDS))


def split_identifier(name: Column) -> Column:
    """Lower-case parts of an identifier without stopwords.

    With an underscore in it the name is cut at underscores alone, else at
    humps (parseJSON -> parse, json) and white space.
    """
    humps = F.split(F.trim(F.regexp_replace(F.regexp_replace(name, _HUMP, " "), r"\s+", " ")), " ")
    parts = F.when(F.contains(name, F.lit("_")), F.split(name, "_")).otherwise(humps)
    return _kept(F.transform(F.coalesce(parts, F.array().cast("array<string>")), F.lower))


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters in lower case, without stopwords and single letters."""
    return _kept(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), F.array().cast("array<string>")), 2)


def _runs(tokens: Column, n: int) -> Column:
    joined = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, joined).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """All runs of the given lengths, repeats included, shorter lengths first."""
    # Bound by a lambda, the tokens are computed once, not for each run.
    return F.get(F.transform(F.array(tokens), lambda t: F.concat(*[_runs(t, n) for n in sizes])), F.lit(0))


def extract_ngrams(text: Column, max_n: int = 3) -> Column:
    return ngrams(tokenize(text), tuple(range(1, max_n + 1)))


def signature_tokens(signature: Column) -> Column:
    """Identifier parts of a signature; closing brackets vanish, opening ones separate."""
    return split_identifier(F.translate(F.replace(signature, F.lit(")"), F.lit("")), "(", " "))


def snippet(node: dict[str, Column] | None = None) -> Column:
    """signature | first line of the docstring (cut at 150), or kind: name where both are empty."""
    c = node or {k: F.col(k) for k in ("signature", "docstring", "kind", "name")}
    # \s has vertical tabs too, and $ also matches before a last line separator.
    doc = F.substring_index(F.regexp_replace(c["docstring"], r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z", ""), "\n", 1)
    doc = F.when(F.length(doc) > 150, F.concat(F.substring(doc, 1, 147), F.lit("..."))).otherwise(doc)
    # An absent part is null, which concat_ws leaves out; a docstring of white space is a part, though empty.
    parts = F.concat_ws(" | ", F.nullif(c["signature"], F.lit("")), F.when(c["docstring"] != "", doc))
    bare = F.concat(c["kind"], F.lit(": "), c["name"])
    nothing = (F.coalesce(c["signature"], F.lit("")) == "") & (F.coalesce(c["docstring"], F.lit("")) == "")
    return F.when(nothing, bare).otherwise(parts)


def occurrences(text: Column, word: str) -> Column:
    """Number of non-overlapping places of a substring."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def control_flow(signature: Column, docstring: Column) -> Column:
    """Counts of the control words, then of opening brackets in the signature."""
    signature, docstring = F.coalesce(signature, F.lit("")), F.coalesce(docstring, F.lit(""))
    text = F.lower(F.concat(signature, F.lit(" "), docstring))
    return F.array(*[occurrences(text, w) for w in CONTROL_WORDS], occurrences(signature, "(") + occurrences(signature, "["))


def type_words(signature: Column) -> Column:
    """Counts of the type words in a signature."""
    text = F.lower(F.coalesce(signature, F.lit("")))
    return F.array(*[occurrences(text, w) for w in TYPE_WORDS])


FEATURE_NAMES = (*CONTROL_WORDS, "nesting", *TYPE_WORDS)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Of two equally long number arrays: 1 if they have no elements, 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * x).cast("double"))
    na, nb = square(a), square(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(na) * F.sqrt(nb)))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell pattern: *, ?, [set], [!set]."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end + 1
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]" else c)
    return "(?s)^" + "".join(out) + r"\z"


def client_score(query: str, name: Column, docstring: Column, filepath: Column) -> Column:
    """The page's search box: for each query word (cut at white space and _, longer than 1) 10 in the name, 3 in the docstring, 1 in the path, 5 more at the name's start."""
    import re

    name, docstring, filepath = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, docstring, filepath))
    score = F.lit(0)
    for w in (w for w in re.split(r"[\s_]+", query.lower()) if len(w) > 1):
        for hit, points in ((F.contains(name, F.lit(w)), 10), (F.contains(docstring, F.lit(w)), 3), (F.contains(filepath, F.lit(w)), 1), (F.startswith(name, F.lit(w)), 5)):
            score = score + F.when(hit, points).otherwise(0)
    return score
