"""Text clean-up and JS/TS segmentation as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions.columns import is_match, let, pieces

#: Nesting that one regex reads; a text with a back-tick left over is read by the automaton, which
#: costs some twenty times as much. A level adds 33 characters to the pattern.
TEMPLATE_DEPTH = 64


def _template_pattern(depth: int) -> str:
    """A template literal with ${...} nested up to `depth`."""
    inner = "(?!)"
    for _ in range(depth):
        inner = r"\$\{(?:[^\\}$]|\\.|\$(?!\{)|" + inner + r")*+\}"
    return r"`(?:[^`\\$]|\\.|\$(?!\{)|" + inner + r")*+`"


SEGMENT = (
    r"(?s)//[^\n]*+"
    r"|/\*.*?(?:\*/|\z)"
    r'|"(?:[^"\\\n]|\\.)*+"'
    r"|'(?:[^'\\\n]|\\.)*+'"
    "|" + _template_pattern(TEMPLATE_DEPTH)
)


def strip_spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(v.SPACE_CHARS))


def _collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(v.BLANK_LINES), F.lit("\n\n"))


def strip_comments_java(c: Column) -> Column:
    return _collapse_blank_lines(F.regexp_replace(c, F.lit(v.JAVA_COMMENT_OR_STRING), F.lit("$1")))


def is_comment(piece: Column) -> Column:
    return F.startswith(piece, F.lit("//")) | F.startswith(piece, F.lit("/*"))


# --- nesting of any depth: a pushdown automaton over tokens ------------------------------

#: A token, and in group 1 a quote that closes on its line.
_TOKEN = r"""(?s)("(?=(?:[^"\\\n]|\\.)*+")|'(?=(?:[^'\\\n]|\\.)*+'))|[^`"'\\/*${}\n]++|."""
_CODE, _LINE, _BLOCK, _STRING, _TEMPLATE = range(5)


def _scan(tokens: Column, quotes: Column) -> Column:
    """array<struct<first, last>>: the tokens (from 0) of every comment, string and template.

    One step per token keeps what is being read, the nesting of ${, and the sign before. A
    template without an end is code: reading starts again behind its back-tick, which is
    why the pass over all tokens may be repeated once for each back-tick.
    """
    bounds = "array<struct<first:int,last:int>>"
    none, number = F.lit(""), F.lit(0)

    def state(acc: Column, **new) -> Column:
        names = ("at", "mode", "depth", "before", "escaped", "first", "found")
        return F.struct(*[new.get(n, acc[n]).alias(n) for n in names])

    def ended(acc: Column, last: Column) -> Column:
        return F.concat(acc["found"], F.array(F.struct(acc["first"].alias("first"), last.cast("int").alias("last"))))

    def begun(acc: Column, mode: int, first: Column) -> Column:
        return state(acc, mode=F.lit(mode), depth=number, before=none, escaped=F.lit(False), first=first.cast("int"))

    def closed(acc: Column, last: Column, before: Column = none) -> Column:
        return state(acc, mode=F.lit(_CODE), before=before, found=ended(acc, last))

    def step(acc: Column, x: Column) -> Column:
        t, i, mode, before = x["t"], x["i"], acc["mode"], acc["before"]
        code = (
            F.when((before == "/") & (t == "/"), begun(acc, _LINE, i - 1))
            .when((before == "/") & (t == "*"), begun(acc, _BLOCK, i - 1))
            .when(x["q"] != "", state(begun(acc, _STRING, i), before=t))
            .when(t == "`", begun(acc, _TEMPLATE, i))
            .otherwise(state(acc, before=F.when(t == "/", t).otherwise(none)))
        )
        line = F.when(t == "\n", closed(acc, i - 1)).otherwise(acc)
        block = F.when((before == "*") & (t == "/"), closed(acc, i)).otherwise(state(acc, before=t))
        string = (
            F.when(acc["escaped"], state(acc, escaped=F.lit(False)))
            .when(t == "\\", state(acc, escaped=F.lit(True)))
            .when(t == before, closed(acc, i))
            .otherwise(acc)
        )
        template = (
            F.when(acc["escaped"], state(acc, escaped=F.lit(False), before=none))
            .when(t == "\\", state(acc, escaped=F.lit(True), before=none))
            .when((before == "$") & (t == "{"), state(acc, depth=acc["depth"] + 1, before=none))
            .when((t == "}") & (acc["depth"] > 0), state(acc, depth=acc["depth"] - 1, before=none))
            .when((t == "`") & (acc["depth"] == 0), closed(acc, i))
            .otherwise(state(acc, before=F.when(t == "$", t).otherwise(none)))
        )
        read = F.when(mode == _CODE, code).when(mode == _LINE, line).when(mode == _BLOCK, block).when(mode == _STRING, string).otherwise(template)
        return F.when(i < acc["at"], acc).otherwise(read)

    def whole(entries: Column) -> Column:
        size = F.size(entries)

        def again(acc: Column, _: Column) -> Column:
            """Goes on behind a template that did not end."""
            ready = state(acc, at=F.when(acc["mode"] == _TEMPLATE, acc["first"] + 1).otherwise(acc["at"]), mode=F.lit(_CODE), before=none, escaped=F.lit(False))
            return F.when(acc["at"] >= size, acc).otherwise(
                let(F.aggregate(entries, ready, step), lambda r: F.when(r["mode"] == _TEMPLATE, r).otherwise(
                    state(r, at=size, found=F.when(r["mode"].isin(_LINE, _BLOCK), ended(r, size - 1)).otherwise(r["found"]))
                ))
            )

        start = F.struct(
            number.alias("at"), F.lit(_CODE).alias("mode"), number.alias("depth"), none.alias("before"), F.lit(False).alias("escaped"),
            number.alias("first"), F.array().cast(bounds).alias("found"),
        )
        ticks = F.size(F.filter(entries, lambda e: e["t"] == "`"))
        return F.aggregate(F.sequence(F.lit(0), ticks), start, again)["found"]

    entries = F.transform(F.arrays_zip(tokens.alias("t"), quotes.alias("q")), lambda z, i: F.struct(z["t"].alias("t"), z["q"].alias("q"), i.alias("i")))
    return let(entries, whole)


def _nested_pieces(c: Column) -> Column:
    """As pieces(c, SEGMENT), for templates of any nesting."""

    def cut(tokens: Column) -> Column:
        def joined(found: Column) -> Column:
            def text(first: Column, last: Column) -> Column:
                return F.array_join(F.slice(tokens, first + 1, F.greatest(last - first + 1, F.lit(0))), "")

            def both(b: Column, i: Column) -> Column:
                behind = F.when(i > 0, F.element_at(found, F.greatest(i, F.lit(1)))["last"] + 1).otherwise(F.lit(0))
                return F.array(text(behind, b["first"] - 1), text(b["first"], b["last"]))

            rest = F.when(F.size(found) > 0, F.element_at(found, F.greatest(F.size(found), F.lit(1)))["last"] + 1).otherwise(F.lit(0))
            return F.concat(F.flatten(F.transform(found, both)), F.array(text(rest, F.size(tokens))))

        return let(_scan(tokens, F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(1))), joined)

    return let(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0)), cut)


def js_pieces(c: Column) -> Column:
    """[code, segment, code, ..., code] of JS/TS text. One regex reads templates nested up to
    TEMPLATE_DEPTH; where it leaves a back-tick in code, the automaton reads the text."""

    def checked(parts: Column) -> Column:
        left = F.exists(F.filter(parts, lambda p, i: ~is_match(i)), lambda p: F.contains(p, F.lit("`")))
        return F.when(left, _nested_pieces(c)).otherwise(parts)

    plain = pieces(c, SEGMENT)
    return F.when(F.contains(c, F.lit("`")), let(plain, checked)).otherwise(plain)


def strip_comments_react(c: Column) -> Column:
    without_jsx = F.regexp_replace(c, F.lit(v.JSX_COMMENT), F.lit(""))
    kept = F.filter(let(without_jsx, js_pieces), lambda p, i: ~(is_match(i) & is_comment(p)))
    trimmed = F.regexp_replace(F.array_join(kept, ""), F.lit(v.LINE_END_BLANKS), F.lit("\n"))
    return _collapse_blank_lines(trimmed)


def strip_doc_tags(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(v.DOC_TAGS), F.lit(""))


def strip_loggers_java(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(v.JAVA_LOGGER), F.lit("\n"))


def strip_loggers_react(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(v.REACT_LOGGER), F.lit("\n"))


def segment_kind(piece: Column) -> Column:
    """Kind of a non-code piece; the opening characters decide it."""
    return (
        F.when(F.startswith(piece, F.lit("//")), "line_comment")
        .when(F.startswith(piece, F.lit("/*")), "block_comment")
        .when(F.startswith(piece, F.lit("`")), "template")
        .otherwise("string")
    )


def segments(c: Column) -> Column:
    """array<struct<kind, text>> of JS/TS text in order; joined texts give the input."""
    typed = F.transform(
        js_pieces(c),
        lambda p, i: F.struct(
            F.when(is_match(i), segment_kind(p)).otherwise("code").alias("kind"), p.alias("text")
        ),
    )
    return F.filter(typed, lambda s: s["text"] != "")


def has_open_template(c: Column) -> Column:
    """True where a back-tick stayed in code: a template without an end."""
    return F.exists(segments(c), lambda s: (s["kind"] == "code") & F.contains(s["text"], F.lit("`")))


def _code_before(gaps: Column, k: Column) -> Column:
    """The last CODE_TAIL_CHARS characters of code up to gap k (0-based)."""
    n = v.CODE_TAIL_CHARS

    def last(count: int) -> Column:
        return F.array_join(F.slice(gaps, F.greatest(k - (count - 2), F.lit(1)), F.least(k + 1, F.lit(count))), "")

    def enough(t: Column, count: int, more: Column) -> Column:
        return F.when((F.length(t) >= n) | (k < count - 1), t).otherwise(more)

    # a few gaps are nearly always enough: many are joined only where strings stand side by side
    whole = F.array_join(F.slice(gaps, F.lit(1), k + 1), "")
    many = let(last(n), lambda t: enough(t, n, whole))
    return F.right(let(last(8), lambda t: enough(t, 8, many)), F.lit(n))


def java_literals(c: Column) -> Column:
    """array<struct<text, literal>>: pieces in order, `literal` set where maskable."""
    return F.transform(
        pieces(c, v.JAVA_STRING),
        lambda p, i: F.struct(p.alias("text"), F.when(is_match(i), p).alias("literal")),
    )


def react_literals(c: Column) -> Column:
    """As java_literals; module specifiers and templates with ${ are not maskable."""

    def typed(parts: Column) -> Column:
        def marked(gaps: Column) -> Column:
            def entry(p: Column, i: Column) -> Column:
                quoted = F.startswith(p, F.lit("'")) | F.startswith(p, F.lit('"'))
                plain_template = F.startswith(p, F.lit("`")) & ~F.contains(p, F.lit("${"))
                k = F.floor(i / 2).cast("int")
                specifier = F.rlike(_code_before(gaps, k), F.lit(v.SPECIFIER_CONTEXT))
                literal = (
                    F.when(is_match(i) & plain_template, p)
                    .when(is_match(i) & quoted, F.when(~specifier, p))
                )
                return F.struct(p.alias("text"), literal.alias("literal"))

            return F.transform(parts, entry)

        # the gaps once for a text, not once for each of its strings
        return let(F.filter(parts, lambda p, i: ~is_match(i)), marked)

    return let(js_pieces(c), typed)
