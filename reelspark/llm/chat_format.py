"""Chat formatting by schema fingerprinting; DataFrame functions only.

Records come as JSON in different layouts. The nested field paths of a record, sorted and hashed,
are its schema fingerprint; the fingerprint selects a declarative mapping, which lists where each
canonical turn's role and content are. Canonical turns are then written in one template, with the
template's control strings escaped inside texts, and with the spans that carry training loss.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: every nested field path of the layout, sorted. turns: either (role, path of its text) in order,
    or one (list, role, content) below it, where the content may come in parts."""

    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    parts: bool = False


LAYOUTS = [
    Layout(("messages[].content", "messages[].role"), listed=("messages", "role", "content")),
    Layout(("messages[]",), listed=("messages", "role", "content")),
    Layout(("messages[].content[].text", "messages[].content[].type", "messages[].role"), listed=("messages", "role", "content"), parts=True),
    Layout(("messages[].content?", "messages[].role"), listed=("messages", "role", "content"), parts=True),
    Layout(("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value")),
    Layout(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(("input", "instruction", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
]
#: Names of the roles in the layout of ``from`` and ``value``.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


#: The parser's own limit on a text's length, lifted.
_LONG = {"maxStringLen": str(2**31 - 1)}
#: Characters of a record from which on its texts are cut before their kinds are asked for, and those that stay of each.
LONG_RECORD, SHOWN = 4_000_000, 256
_TEXT = r'"((?:[^"\\]|\\u[0-9a-fA-F]{4}|\\[^u]){0,' + str(SHOWN) + r'}+)(?:[^"\\]++|\\.)*+"'


def _top(record: Column) -> Column:
    return F.from_json(record, "map<string,string>", _LONG)


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON record, at any depth: ``name``, ``object.name``, ``list[].name``, ``list[]``.

    Paths come from the kinds of the values, so a text that looks like JSON is a text. A path whose values
    are of several kinds, text in one place and a list in another, ends in ``?``. None for what isn't JSON
    or repeats a name in one object.
    """
    short = F.when(F.char_length(record) > LONG_RECORD, F.regexp_replace(record, _TEXT, '"$1"')).otherwise(record)
    kinds = F.schema_of_variant(F.try_parse_json(short))
    # Names other than plain ones stand in backticks there, so no name is taken for a kind.
    tokens = F.regexp_extract_all(kinds, F.lit(r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>|[A-Z]+(?:\(\d+,\d+\))?"), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, t: Column) -> Column:
        state = lambda open_, at, paths: F.struct(open_.alias("open"), at.alias("at"), paths.alias("paths"))
        top, name = F.element_at(s["open"], -1), F.regexp_replace(t, "^`?(.*?)`?: $", "$1")
        in_list = F.concat(s["at"], F.lit("[]"))
        return (
            F.when(t.endswith(": "), state(s["open"], F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name)), s["paths"]))
            .when(t == "OBJECT<", state(F.array_append(s["open"], s["at"]), s["at"], s["paths"]))
            .when(t == "ARRAY<", state(F.array_append(s["open"], in_list), in_list, s["paths"]))
            .when(t == ">", state(F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1), s["at"], s["paths"]))
            .otherwise(state(s["open"], s["at"], F.array_append(s["paths"], F.when(t == "VARIANT", F.concat(s["at"], F.lit("?"))).otherwise(s["at"]))))
        )

    return F.coalesce(F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["paths"])), F.array().cast("array<string>"))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _plain_turn(role: str, content: str):
    def turn(m: Column) -> Column:
        who = F.coalesce(m[role], F.lit(""))
        return F.struct((role_name(who) if role == "from" else who).alias("role"), F.coalesce(m[content], F.lit("")).alias("content"))

    return turn


def _turn_in_parts(role: str, content: str):
    def turn(m: Column) -> Column:
        said = m[content]
        parts = F.transform(F.try_variant_get(said, "$", "array<map<string,string>>"), lambda p: F.coalesce(p["text"], F.lit("")))
        text = F.when(F.schema_of_variant(said).startswith("ARRAY"), F.array_join(parts, "")).otherwise(F.try_variant_get(said, "$", "string"))
        return F.struct(F.coalesce(F.try_variant_get(m[role], "$", "string"), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))

    return turn


def canonical_turns(record: Column, layouts: list[Layout] = LAYOUTS) -> Column:
    """Turns of a JSON record by the mapping that its fingerprint selects; null for unknown layouts."""
    # One element, so that paths and fields are read once for all layouts.
    once = F.array(F.struct(fingerprint(field_paths(record)).alias("known"), _top(record).alias("top")))

    def chosen(r: Column) -> Column:
        out = F.lit(None).cast(TURNS)
        for layout in layouts:
            if layout.listed and layout.parts:
                turns = F.transform(F.from_json(r["top"][layout.listed[0]], "array<map<string,variant>>", _LONG), _turn_in_parts(*layout.listed[1:]))
            elif layout.listed:
                turns = F.transform(F.from_json(r["top"][layout.listed[0]], "array<map<string,string>>", _LONG), _plain_turn(*layout.listed[1:]))
            else:
                turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(r["top"][path], F.lit("")).alias("content")) for role, path in layout.fields])
            out = F.when(r["known"] == fingerprint(F.array(*[F.lit(p) for p in layout.paths])), turns).otherwise(out)
        return out

    return F.transform(once, chosen)[0]


def role_name(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])[role], role)


def escape(text: Column) -> Column:
    """A control string's ``<|`` gets a backslash between, ``<`` + n backslashes + ``|`` one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, record): rows by turn as JSON records, in the layouts in which such data comes.

    A lone user and assistant pair is a prompt and response, prompt and completion, instruction and
    output, or a list of messages; others are lists of messages, plain or with contents in parts, or
    of senders and values. Which of them, a hash of the id decides. Null roles and texts are empty;
    null turns come last; ties are ordered by role, then text; repeated rows stay. A null id is a
    conversation of its own. An empty table gives an empty table.
    """
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    r = rows.select(rows[id_col].alias("conv"), rows[turn_col].alias("turn"), rows[role_col].alias("role"), rows[text_col].alias("text"))
    r = r.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    user, assistant = F.lit("user"), F.lit("assistant")
    said = lambda i: F.get("t", F.lit(i))["content"]
    pair = (F.size("t") == 2) & (F.get("t", F.lit(0))["role"] == user) & (F.get("t", F.lit(1))["role"] == assistant)
    kind = F.pmod(F.xxhash64("conv"), F.lit(4))
    two = lambda a, b: F.to_json(F.struct(said(0).alias(a), said(1).alias(b)))
    plain = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    in_parts = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["content"].alias("text"))).alias("content"))).alias("messages")))
    sender = lambda x: F.when(x["role"] == user, F.lit("human")).otherwise(F.lit("gpt"))
    sent = F.to_json(F.struct(F.transform("t", lambda x: F.struct(sender(x).alias("from"), x["content"].alias("value"))).alias("conversations")))
    two_roles = F.forall("t", lambda x: (x["role"] == user) | (x["role"] == assistant))
    record = (
        F.when(pair & (kind == 0), two("prompt", "response"))
        .when(pair & (kind == 1), two("prompt", "completion"))
        .when(pair & (kind == 2), two("instruction", "output"))
        .when(~pair & two_roles & (kind == 2), sent)
        .when(~pair & (kind == 1), in_parts)
        .otherwise(plain)
    )
    return r.select("conv", record.alias("record"))


def format_chats(recs: DataFrame) -> DataFrame:
    """(conv, formatted, loss): the template's text and the spans of the assistant's texts in it.

    recs: (conv, record). loss: array of (start, length) in code points. Every record is worked on by
    itself, whatever ids are null or repeated: there is no exchange. Records in an unknown layout keep their
    row, with null ``formatted`` and ``loss``; a record without turns has an empty text; texts may be as long as
    a column holds. An empty table gives an empty table.
    """
    turns = recs.select("conv", canonical_turns(F.col("record")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    parts = turns.select("conv", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["content"]).alias("body"), (t["role"] == "assistant").alias("learn"))).alias("parts"))
    tail = F.lit(f"{END}\n")
    formatted = F.when(F.col("parts").isNotNull(), F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], tail)), ""))
    sized = F.transform("parts", lambda p: F.struct(F.char_length(p["head"]).cast("long").alias("head"), F.char_length(p["body"]).cast("long").alias("body"), p["learn"].alias("learn")))
    return parts.select("conv", formatted.alias("formatted"), _spans(sized).alias("loss"))


#: Turns whose lengths are summed at once.
_BLOCK = 64


def _spans(sized: Column) -> Column:
    """(start, length) of the bodies to learn, from (head, body, learn): running sums over blocks of turns, then within one."""
    once = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))  # noqa: E731  worked out once, however often it is used
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
    some = lambda lengths, first, n: F.slice(lengths, first + 1, n)

    def placed(turns: Column) -> Column:
        lengths = F.transform(turns, lambda t: t["head"] + t["body"] + (len(END) + 1))

        def by_block(all_: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / _BLOCK).cast("int")), lambda b: total(some(all_, b * _BLOCK, F.lit(_BLOCK))))

            def upto(sums: Column) -> Column:
                before = F.transform(sums, lambda _, b: total(some(sums, F.lit(0), b)))

                def of(starts: Column) -> Column:
                    def span(t: Column, i: Column) -> Column:
                        b = F.floor(i / _BLOCK).cast("int")
                        start = F.get(starts, b) + total(some(all_, b * _BLOCK, i - b * _BLOCK)) + t["head"]
                        return F.when(t["learn"], F.struct(start.alias("start"), t["body"].alias("length")))

                    return F.filter(F.transform(turns, span), lambda s: s.isNotNull())

                return once(before, of)

            return once(blocks, upto)

        return once(lengths, by_block)

    return F.when(sized.isNotNull(), once(sized, placed))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.char_length(piece))
        cut = F.locate("\n", body)
        return F.struct(_unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.char_length(body))).alias("content"))

    return F.transform(pieces, turn)


def digest(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What is read back from ``format_chats``'s rows: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; null where the layout is unknown."""
    turns = chats.select("conv", "formatted", "loss", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return turns.select(
        F.col("conv").alias(id_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
