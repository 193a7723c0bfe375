"""Cleaning of translated DDL text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Keywords only Oracle knows, and the shape of a model's answer (group 3 is the confidence).
ORACLE_NOISE = r"(?iU)\b(EDITIONABLE|NONEDITIONABLE|FORCE)\b\s*"
ANSWER_PATTERN = r'(?s)"Answer":\s*(.*?)\s*,\s*"Reasoning":\s*(.*?),\s*"Confidence":\s*(.*?)\s'


def strip_oracle_noise(ddl: Column) -> Column:
    """Drop Oracle-only keywords and collapse blanks; text inside literals is treated alike."""
    return F.regexp_replace(F.regexp_replace(ddl, ORACLE_NOISE, ""), "[ \t]+", " ")


def unescape_ddl(ddl: Column) -> Column:
    r"""Turn the escapes \n, \t, \" and \\ into the characters they stand for; nothing else changes.

    The text is split at escaped backslashes first, so their halves never pair with what follows.
    """
    piece = lambda p: F.replace(F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    return F.array_join(F.transform(F.split(ddl, r"\\\\"), piece), "\\")


def _quoted(name: Column) -> Column:
    """A name as a regular expression that matches it literally."""
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _literal_replacement(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def remap_schema(ddl: Column, source: Column, target: Column, target_dialect: Column) -> Column:
    """Point qualified names at the target schema.

    PostgreSQL: the quoted source schema becomes the quoted, lower-cased target schema. MySQL: the
    qualifier is dropped, quoted or bare. Oracle targets are left alone.
    """
    has_source = source.isNotNull() & (source != "")
    has_both = has_source & target.isNotNull() & (target != "")
    pattern = F.concat(F.lit('(?iU)"'), _quoted(source), F.lit(r'"(?=\W)'))
    renamed = F.regexp_replace(ddl, pattern, F.concat(F.lit('"'), _literal_replacement(F.lower(target)), F.lit('"')))
    ticked = F.regexp_replace(ddl, F.concat(F.lit("(?iU)`"), _quoted(source), F.lit(r"`\.")), F.lit(""))
    bare = F.regexp_replace(ticked, F.concat(F.lit(r"(?iU)\b"), _quoted(source), F.lit(r"\.")), F.lit(""))
    return (
        F.when((target_dialect == "postgresql") & has_both, renamed)
        .when((target_dialect == "mysql") & has_source, bare)
        .otherwise(ddl)
    )


# A quoted name as a whole, a word, or what stands between words.
TOKEN = r'(?U)"[^"]*"|\w+|[^\w"]+|"'


def tokens(text: Column) -> Column:
    """The text in pieces; joined they give the text again."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def requote(text: Column, spelling: Column) -> Column:
    """Quote the names of the map ``spelling`` (lower-case name to its spelling) where they stand bare in the text.

    The text is cut into tokens by one scan; a name of several tokens ("Work Note" is three) is a token where it stands, and longer ones come
    before shorter ones. Each token is then looked up in the map. A name that is quoted already is a token of its own and stays; a
    name that holds a quotation mark is not looked for.
    """
    several = F.filter(F.map_keys(spelling), lambda n: (n != "") & ~n.rlike(r"(?U)^\w+$") & ~n.contains('"'))
    ordered = F.array_sort(several, lambda a, b: F.size(tokens(b)) - F.size(tokens(a)))
    # A name ends where a token ends.
    edge = lambda n: F.when(n.rlike(r"(?U)\w$"), F.lit(r"(?!\w)")).otherwise(F.lit(r'(?=[\w"]|$)'))
    literal = lambda n: F.concat(F.lit(r"\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    names = F.array_join(F.transform(ordered, lambda n: F.concat(literal(n), edge(n), F.lit("|"))), "")
    pattern = F.concat(F.lit(r'(?iU)"[^"]*"|'), names, F.lit(r'\w+|[^\w"]+|"'))
    quoted = lambda w: F.concat(F.lit('"'), F.element_at(spelling, F.lower(w)), F.lit('"'))
    found = F.array_join(F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda w: F.coalesce(quoted(w), w)), "")
    return F.when(F.size(spelling) > 0, found).otherwise(text)


def confidence(answer: Column, pattern: str = ANSWER_PATTERN) -> Column:
    """Confidence a model stated about itself, or NULL when the answer has none that reads as a number."""
    raw = F.trim(F.regexp_extract(answer, pattern, 3))
    return F.regexp_replace(raw, '^"+|"+$', "").try_cast("double")
