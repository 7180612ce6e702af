"""Text expressions. Column in, Column out: everything here stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Unicode white space plus the four ASCII separators 0x1c-0x1f, spelled out: an explicit class is
# matched faster than a Unicode-aware one, and the same characters serve to trim.
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_NO_SPACE = WS.replace(r"\x{20}", r"\x{1f}")
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN = "[a-z0-9+#]+"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

Expr = Column | str


def as_col(x: Expr) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once so a lambda body can use it many times without recomputing it."""
    return F.transform(F.array(value), body)[0]


def round_to(x: Column, digits: int) -> Column:
    """Round to a number of decimals, halves to even; cheaper than the decimal-based round."""
    scale = float(10 ** digits)
    return F.rint(x * scale) / scale


def text_or_empty(x: Expr) -> Column:
    return F.coalesce(as_col(x), F.lit(""))


def first_filled(*xs: Expr) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(as_col(x), F.lit("")) for x in xs])


def strip(x: Expr) -> Column:
    return F.btrim(as_col(x), F.lit(WS_CHARS))


def squeeze(x: Expr) -> Column:
    """Trim and turn every run of white space into one space; runs that are one space already are passed over.

    The look ahead rules most characters out by one range before the ranges of white space are tried.
    """
    return F.trim(F.regexp_replace(as_col(x), rf"(?![!-~])(?: (?![!-~]){WS}+|{WS_NO_SPACE}{WS}*)", " "))


def normalize_text(x: Expr) -> Column:
    return squeeze(F.lower(as_col(x)))


def tokenise(x: Expr) -> Column:
    """Lower-case runs of a-z, 0-9, + and #; accented letters split words."""
    return F.regexp_extract_all(F.lower(as_col(x)), F.lit(TOKEN), F.lit(0))


def token_set(x: Expr) -> Column:
    return F.array_distinct(tokenise(x))


def split_lines(x: Expr) -> Column:
    """Lines without their breaks; a trailing break adds no line."""
    unified = F.regexp_replace(as_col(x), LINE_BREAK, "\n")
    body = F.regexp_replace(unified, r"\n\z", "")
    return F.when(unified == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two distinct arrays, 0 when either side is empty."""
    return let(
        F.size(F.array_intersect(left, right)).cast("double"),
        lambda common: F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
        .otherwise(common / (F.size(left) + F.size(right) - common)),
    )


def text_jaccard(left: Expr, right: Expr) -> Column:
    return let(token_set(left), lambda a: let(token_set(right), lambda b: jaccard(a, b)))


def unique_ordered(values: Column) -> Column:
    """First spelling per normalized value, in order, trimmed; blanks dropped. Sorts, so long lists cost n log n."""

    def firsts(rows: Column) -> Column:
        is_first = lambda x, i: (x["key"] != "") & ((i == 0) | (F.get(rows, i - 1)["key"] != x["key"]))
        kept = F.transform(F.filter(rows, is_first), lambda x: F.struct(x["at"].alias("at"), x["item"].alias("item")))
        return F.transform(F.sort_array(kept), lambda x: strip(x["item"]))

    items = F.coalesce(values, F.array().cast("array<string>"))
    keyed = F.transform(items, lambda x, i: F.struct(normalize_text(x).alias("key"), i.alias("at"), x.alias("item")))
    return let(F.sort_array(F.filter(keyed, lambda x: x["key"].isNotNull())), firsts)


def phrase_matches(text: Expr, phrases: list[str] | Column, whole_word: bool = False) -> Column:
    """Phrases contained in the normalized text, in phrase order.

    Containment is by substring ("c" is inside "across"); `whole_word` compares token runs.
    """
    items = phrases if isinstance(phrases, Column) else string_array(phrases)
    if whole_word:
        padded = F.concat(F.lit(" "), F.array_join(tokenise(text), " "), F.lit(" "))
        return let(padded, lambda hay: F.filter(items, lambda p: F.contains(
            hay, F.concat(F.lit(" "), F.array_join(tokenise(p), " "), F.lit(" ")))))
    return let(normalize_text(text), lambda hay: F.filter(items, lambda p: F.contains(hay, normalize_text(p))))


def keyword_overlap(left: Column, right: Column) -> Column:
    """0-100 Jaccard of whole normalized phrases, two decimals."""

    def keys(values: Column) -> Column:
        kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
        return F.array_distinct(F.transform(kept, normalize_text))

    return round_to(100.0 * let(keys(left), lambda a: let(keys(right), lambda b: jaccard(a, b))), 2)


def bullet_lines(text: Expr) -> Column:
    """Lines that start with - or *, without their marks."""
    marked = F.filter(split_lines(text), lambda line: let(
        F.substring(strip(line), 1, 1), lambda mark: (mark == "-") | (mark == "*")))
    return F.transform(marked, lambda line: strip(F.ltrim(line, F.lit("-* "))))


def bullets_or_sentences(text: Expr) -> Column:
    """Bullet lines; without any, pieces between dots or newlines longer than 20 characters."""

    def choose(body: Column) -> Column:
        sentences = F.filter(F.transform(F.split(body, r"[.\n]+", -1), strip), lambda s: F.length(s) > 20)
        return let(bullet_lines(body), lambda bullets: F.when(F.size(bullets) > 0, bullets).otherwise(sentences))

    return let(as_col(text), choose)


def clip_text(x: Expr, limit: int, tail: str = "") -> Column:
    """Cut to `limit` characters, go back to the last space, drop trailing , ; and :."""
    c = as_col(x)
    cut = F.regexp_replace(F.substring(c, 1, limit), r" [^ ]*\z", "")
    cut = F.regexp_replace(cut, r"[,;:]+\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit(tail)))


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def contains_any(hay: Expr, needles: list[str] | Column) -> Column:
    """Whether any needle is a substring of hay; an expression given as hay is evaluated once."""

    def test(h: Column) -> Column:
        if isinstance(needles, Column):
            return F.exists(needles, lambda n: F.contains(h, n))
        out = F.lit(False)
        for needle in needles:
            out = out | F.contains(h, F.lit(needle))
        return out

    return test(F.col(hay)) if isinstance(hay, str) else let(hay, test)


def first_contained(hay: Expr, needles: list[str]) -> Column:
    """First needle, in list order, that is a substring of hay; null when none is."""

    def choose(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for needle in reversed(needles):
            out = F.when(F.contains(h, F.lit(needle)), F.lit(needle)).otherwise(out)
        return out

    return choose(F.col(hay)) if isinstance(hay, str) else let(hay, choose)


def parents_matched(text: Expr, taxonomy: dict[str, list[str]]) -> Column:
    """Parents whose own label or any synonym is a substring of the lower-cased text."""
    return let(
        F.lower(as_col(text)),
        lambda hay: F.array_compact(F.array(*[
            F.when(contains_any(hay, [parent, *synonyms]), F.lit(parent))
            for parent, synonyms in taxonomy.items()
        ])) if taxonomy else F.array().cast("array<string>"),
    )


def occurrences(text: Expr, term: Column) -> Column:
    """Non-overlapping count of term in text."""
    c = as_col(text)
    return ((F.length(c) - F.length(F.replace(c, term, F.lit("")))) / F.length(term)).cast("int")


def title_case(x: Expr) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    runs = F.regexp_extract_all(as_col(x), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def pack_values(values: Column, separator: str, limit: int) -> Column:
    """Greedy packing: join values until the next one would pass `limit` characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, value: Column) -> Column:
        longer = F.concat(acc["cur"], F.lit(separator), value)
        return (
            F.when(acc["cur"] == "", F.struct(acc["done"].alias("done"), value.alias("cur")))
            .when(
                F.length(longer) > limit,
                F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), value.alias("cur")),
            )
            .otherwise(F.struct(acc["done"].alias("done"), longer.alias("cur")))
        )

    return F.aggregate(
        values, empty, step,
        lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))),
    )


def pack_words(x: Expr, limit: int) -> Column:
    """Cut one squeezed text into runs of whole words of at most `limit` characters.

    Linear in the text: each match takes as many whole words as fit, or one over-long word.
    """
    greedy = rf"\S(?:.{{0,{limit - 1}}}(?<=\S)(?!\S)|\S*)"
    return F.transform(F.regexp_extract_all(squeeze(x), F.lit(greedy), F.lit(0)), F.trim)
