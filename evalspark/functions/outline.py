"""Where the words of a query stand: depth of parentheses, clause, scope.

One fold goes over a statement's tokens. ``outline`` notes each token's depth, from which the text
of a clause follows however deep its own subqueries are. ``misplaced`` keeps a stack with one
entry per open parenthesis and finds words that cannot stand where they do. Neither builds a
tree: what is inside an expression is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.binding import bind

# A token with the white space before it; BY belongs to the word before it.
_TOKEN = (
    r"(?is)\s*(?:'[^']*'|\"[^\"]*\"|`[^`]*`|\[[^\]]*\]"
    r"|(?:group|order|partition)\s+by\b|[\p{L}\p{N}_$]+|<=|>=|<>|!=|==|\|\||\S)"
)
_JOIN_SIDES = ["natural", "left", "right", "full", "inner", "cross", "outer"]
_SET_WORDS = ["union", "except", "intersect"]
# What ends each clause at its own depth.
_AFTER_WHERE = ["group by", "having", "window", "order by", "limit", *_SET_WORDS, ";"]
_AFTER_FROM = ["where", *_AFTER_WHERE]


def _words(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " ")


def outline(sql: Column) -> Column:
    """The tokens as structs of place ``i``, ``raw`` text, lower-case ``word``, ``depth`` and ``lead``.

    A parenthesis has the depth outside it. A name after a dot or AS has no word, so that it is
    never taken for a keyword. ``lead`` is the place of the first of the join words that lead up
    to this one. White space between tokens is one space; comments have to be gone.
    """
    found = F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0))
    raw = F.transform(found, lambda t: F.regexp_replace(t, r"^\s+", " "))
    return bind(raw, lambda raws: bind(_facts_of(F.transform(raws, _words)), lambda facts: _placed(raws, facts)))


def _facts_of(words: Column) -> Column:
    """Each word, whether it is a mere name, and whether it goes with the join word before it."""

    def tell(word: Column, before: Column) -> Column:
        return F.struct(
            word.alias("word"),
            (before.isin(".", "as") & (word != "(")).alias("named"),
            (before.isin(_JOIN_SIDES) & word.isin("join", *_JOIN_SIDES)).alias("side"),
        )

    def with_before(ws: Column) -> Column:
        return F.transform(
            ws, lambda w, i: bind(F.when(i > 0, F.get(ws, i - 1)).otherwise(""), lambda before: tell(w, before))
        )

    return bind(words, with_before)


def _placed(raws: Column, facts: Column) -> Column:
    """The tokens of ``outline``.

    The fold notes depths and leads in one text: a list that grows by one would be copied entry
    by entry for each token.
    """

    def step(seen: Column, token: Column) -> Column:
        word, inner = token["word"], seen["depth"]
        outer = F.greatest(inner - 1, F.lit(0))
        lead = F.when(token["side"], seen["lead"]).otherwise(seen["i"])
        own = F.when(word == ")", outer).otherwise(inner)
        return F.struct(
            F.concat(seen["notes"], own.cast("string"), F.lit(","), lead.cast("string"), F.lit(";")).alias("notes"),
            F.when(word == "(", inner + 1).otherwise(own).alias("depth"),
            lead.alias("lead"),
            (seen["i"] + 1).alias("i"),
        )

    def row(notes: Column, raw: Column, i: Column) -> Column:
        def read(note: Column, fact: Column) -> Column:
            return F.struct(
                i.alias("i"),
                raw.alias("raw"),
                F.when(fact["named"], "").otherwise(fact["word"]).alias("word"),
                F.substring_index(note, ",", 1).cast("int").alias("depth"),
                F.substring_index(note, ",", -1).cast("int").alias("lead"),
            )

        return bind(F.get(notes, i), lambda note: bind(F.get(facts, i), lambda fact: read(note, fact)))

    start = F.struct(F.lit("").alias("notes"), F.lit(0).alias("depth"), F.lit(0).alias("lead"), F.lit(0).alias("i"))
    notes = F.split(F.aggregate(facts, start, step, lambda seen: seen["notes"]), ";")
    return bind(notes, lambda all_notes: F.transform(raws, lambda raw, i: row(all_notes, raw, i)))


def _text(tokens: Column, first: Column, end: Column) -> Column:
    """The text from place ``first`` up to ``end``."""
    return F.trim(F.array_join(F.transform(F.slice(tokens, first + 1, end - first), lambda t: t["raw"]), ""))


def _end(tokens: Column, head: Column, words: list[str]) -> Column:
    """The place where what ``head`` opens ends: a lesser depth, one of the words, or the last token."""
    after = F.slice(tokens, head["i"] + 2, F.size(tokens))
    ends = F.filter(after, lambda t: (t["depth"] < head["depth"]) | ((t["depth"] == head["depth"]) & t["word"].isin(words)))
    places = F.transform(ends, lambda t: F.when(t["word"] == "join", t["lead"]).otherwise(t["i"]))
    return F.coalesce(F.array_min(places), F.size(tokens))


def clause(tokens: Column, head: str, ends: list[str]) -> Column:
    """The text behind the outermost, first ``head``; null if there is none."""

    def read(heads: Column) -> Column:
        first = F.array_min(F.transform(heads, lambda t: F.struct(t["depth"].alias("depth"), t["i"].alias("i"))))
        text = bind(first, lambda at: _text(tokens, at["i"] + 1, _end(tokens, at, ends)))
        return F.when((F.size(heads) > 0) & (text != ""), text)

    return bind(F.filter(tokens, lambda t: t["word"] == head), read)


def filters(tokens: Column) -> Column:
    return clause(tokens, "where", _AFTER_WHERE)


def grouping(tokens: Column) -> Column:
    return clause(tokens, "group by", ["having", "window", "order by", "limit", *_SET_WORDS, ";"])


def ordering(tokens: Column) -> Column:
    return clause(tokens, "order by", ["limit", *_SET_WORDS, ";", "rows", "range", "groups"])


def joins(tokens: Column) -> Column:
    """Every join with its condition, at any depth: distinct texts, sorted."""
    heads = F.filter(tokens, lambda t: t["word"] == "join")
    texts = F.transform(heads, lambda t: _text(tokens, t["lead"], _end(tokens, t, ["join", ",", *_AFTER_FROM])))
    return F.array_sort(F.array_distinct(texts))


# Words and signs behind which something has to come, and what cannot be that.
_WANTING = [
    "from", "where", "having", "on", "and", "or", "not", "limit", "join", "in", "like", "between",
    "is", "when", "then", *_SET_WORDS, ".", "=", "==", "<", ">", "<=", ">=", "<>", "!=", "||", "/", "%",
]
_NO_OPERAND = [
    ")", ",", ";", "from", "where", "group by", "having", "order by", "limit", "join", "on", "and",
    "or", "when", "then", "else", "end", *_SET_WORDS,
]
# Signs that cannot come first in parentheses.
_NEVER_FIRST = ["=", "==", "<", ">", "<=", ">=", "<>", "!=", "||", "/", "%", ",", ".", "and", "or", "from", "having", "on", "join"]
# A query's clauses in the order they have to come in.
_RANKS = {"select": 1, "from": 2, "where": 3, "group by": 4, "having": 5, "order by": 6, "limit": 7}
# Functions whose arguments may hold a FROM.
_FROM_CALLS = ["extract", "trim", "substring", "overlay", "position"]
# Entries of the stack: parentheses just opened, of an expression, of a call that takes FROM.
# A query has the rank of its last clause and _QUERY on top; a query in parentheses counts as whole.
_NEW, _PLAIN, _TAKES_FROM, _QUERY = -1, -2, -3, 100
_WHOLE = _QUERY + 1


# What a token does to the stack.
_OTHER, _OPENS, _CLOSES, _STOPS, _SETS, _CASE, _END = range(7)


def _facts(word: Column, before: Column) -> Column:
    """What is to be known of a token and the one before it, so that the fold compares no texts."""

    def tell(name: Column) -> Column:
        from_as_word = (word == "from") & (before == "distinct")
        rank = F.coalesce(*[F.when(word == head, rank) for head, rank in _RANKS.items()], F.lit(0))
        does = F.when(word == "(", _OPENS).when(word == ")", _CLOSES).when(word == ";", _STOPS)
        does = does.when(name, _OTHER).when(word.isin(_SET_WORDS), _SETS)
        return F.struct(
            name.alias("name"),
            does.when(word == "case", _CASE).when(word == "end", _END).otherwise(_OTHER).alias("does"),
            F.when(name | from_as_word, 0).otherwise(rank).alias("rank"),
            word.isin("select", "with", "values").alias("heads"),
            (before.isin(_WANTING) & word.isin(_NO_OPERAND) & ~name).alias("wanted"),
            ((before == "(") & word.isin(_NEVER_FIRST)).alias("never_first"),
            ((word == "where") & (before == "(") | word.isin("order by", "limit")).alias("anywhere"),
            before.isin(_FROM_CALLS).alias("takes_from"),
        )

    return bind((before.isin(".", "as") & ~word.isin("(", ")", ",", ";")) | (word == "_"), tell)


def misplaced(blanked: Column) -> Column:
    """Whether some word cannot stand where it does.

    Found are operands left out, also inside parentheses, clauses that come twice, out of order or
    outside any query, CASE without END, and parentheses that do not pair. The statement comes in
    lower case, without comments, and with ``_`` for literals and quoted names.
    """
    spaced = F.concat(F.regexp_replace(blanked, r"\s+", " "), F.lit(" ;"))
    return bind(spaced, lambda text: F.when(_flat(text), False).otherwise(_fold_misplaced(text)))


def _either(words: list[str]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def _is_word(token: str) -> bool:
    return token[0].isalpha()


# For a cheap look at statements without queries in them: parentheses without a clause's word, ...
_CLAUSE_WORD = _either([*_RANKS, "with", "values", "case", "end", *_SET_WORDS])
_ASIDE = rf"\((?:(?!{_CLAUSE_WORD})[^()])*\)"
# ... the clauses of a single select in their order, ...
_TO_NEXT = rf"(?:(?!{_CLAUSE_WORD})[^();])*"
_IN_ORDER = "^ ?" + "".join(
    rf"(?:\b{word}\b{_TO_NEXT})" + ("" if word == "select" else "?") for word in _RANKS
) + ";$"
# ... and neighbours that the fold would look at.
_SUSPECT = (
    rf"(?:{_either([t for t in _WANTING if _is_word(t)])}|[.=<>|/%])\s*"
    rf"(?:[),;]|{_either([t for t in _NO_OPERAND if _is_word(t)])})"
    rf"|\(\s*(?:[=<>!|/%,.]|{_either([t for t in _NEVER_FIRST if _is_word(t)])})"
)


def _flat(spaced: Column) -> Column:
    """Whether nothing can be misplaced: one select, its clauses in order, no operand left out."""
    once = F.regexp_replace(spaced, _ASIDE, " _ ")
    return ~spaced.rlike(_SUSPECT) & F.regexp_replace(once, _ASIDE, " _ ").rlike(_IN_ORDER)


def _fold_misplaced(spaced: Column) -> Column:
    words = F.regexp_extract_all(spaced, F.lit(_TOKEN.replace("(?:'", "('", 1)), F.lit(1))
    facts = bind(
        words,
        lambda ws: F.transform(
            ws, lambda w, i: bind(F.when(i > 0, F.get(ws, i - 1)).otherwise(""), lambda before: _facts(w, before))
        ),
    )

    def step(seen: Column, token: Column) -> Column:
        stack, does, rank = seen["stack"], token["does"], token["rank"]
        top = F.element_at(stack, -1)
        # What the parentheses are, told by their first word.
        opened = (
            F.when(top != _NEW, top)
            .when(token["heads"], _QUERY)
            .when(does == _OPENS, _WHOLE)
            .otherwise(_PLAIN)
        )

        def judge(kind: Column) -> Column:
            query, nested = kind >= _QUERY, F.size(stack) > 1
            taken = (rank == _RANKS["from"]) & (kind == _TAKES_FROM)
            bad = (
                (token["wanted"] & ~seen["named"])
                | token["never_first"]
                | ((rank > 0) & F.when(query, kind - _QUERY >= rank).otherwise(~(taken | token["anywhere"])))
                | ((does == _SETS) & (~query | (kind == _QUERY)))
                | ((does == _CLOSES) & ~nested)
                | ((does == _STOPS) & (nested | (seen["cases"] != 0)))
                | ((does == _END) & (seen["cases"] == 0))
            )
            now = F.when(does == _SETS, _QUERY).when((rank > 0) & query, _QUERY + rank).otherwise(kind)
            outer = F.slice(stack, 1, F.size(stack) - 1)
            inner = F.when(token["takes_from"], _TAKES_FROM).otherwise(_NEW)
            return F.struct(
                F.when(does == _OPENS, F.concat(outer, F.array(now, inner)))
                .when((does == _CLOSES) & nested, outer)
                .when(now == top, stack)
                .otherwise(F.concat(outer, F.array(now)))
                .alias("stack"),
                token["name"].alias("named"),
                (seen["cases"] + F.when(does == _CASE, 1).when(does == _END, -1).otherwise(0)).alias("cases"),
                bad.alias("bad"),
            )

        # What is wrong once stays wrong.
        return F.when(seen["bad"], seen).otherwise(bind(opened, judge))

    start = F.struct(
        F.array(F.lit(_NEW)).alias("stack"),
        F.lit(False).alias("named"),
        F.lit(0).alias("cases"),
        F.lit(False).alias("bad"),
    )
    return F.aggregate(facts, start, step, lambda seen: seen["bad"])
