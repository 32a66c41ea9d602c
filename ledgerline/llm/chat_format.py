"""Chat formatting by schema fingerprint (DataFrame functions only).

Records of unknown layout arrive as VARIANT. The nested field paths of a record, as far as some mapping reads them, are
hashed; the hash selects a declarative ``Layout`` that says where the turns are. Further fields (ids, sources, times) of
the record or of its messages don't change the hash. Turns then go through one template that marks them and escapes
control strings in the texts so that the output can be read back exactly.

Defined results: an unknown layout, a NULL record and an empty list give no turns (``layout`` NULL for the first
two; ``unknown_print``, the hash of all its field paths, tells kinds of unknown records apart and counts them); a NULL role
or text is the empty string; a text in parts is its parts' texts, joined by a blank line, without parts that have none
(images); a text that is an object is its JSON; a list with items that aren't objects or have no field that is read is unknown; repeated turns stay;
extra columns of the input are kept as long as their names differ from the ones added (``layout, unknown_print, turns,
formatted, loss_spans``), which replace columns of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.prefix_scan import let, running_sums

TURN_TYPE = "array<struct<role:string,text:string>>"

# -- layouts --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ListTurns:
    """Turns are the objects of one list; ``roles`` renames speakers to canonical roles. The text of the field ``system``
    beside the list, if there is any, is a turn before them."""
    path: str
    role: str
    text: str
    roles: dict = field(default_factory=dict)
    system: str | None = None

    def turns(self, record: Column) -> Column:
        renamed = F.create_map(*[F.lit(x) for pair in self.roles.items() for x in pair]) if self.roles else None

        def one(t: Column) -> Column:
            role = F.try_variant_get(t, f"$.{self.role}", "string")
            if renamed is not None:
                role = F.coalesce(F.try_element_at(renamed, F.lower(role)), role)
            return _turn(role, _text(t, self.text))

        turns = F.transform(_items(record, self.path), one)
        if self.system is None:
            return turns
        first = F.nullif(_text(record, self.system), F.lit(""))
        return F.concat(F.when(first.isNotNull(), F.array(_turn(F.lit("system"), first)))
                        .otherwise(F.array().cast(TURN_TYPE)), turns)


@dataclass(frozen=True)
class FieldTurns:
    """Each turn is built from fixed fields: ``(role, fields)``; several fields are joined by a blank line.
    A turn whose fields are all NULL or empty is left out when it is ``optional``."""
    parts: tuple
    optional: tuple = ("system",)

    def turns(self, record: Column) -> Column:
        turns = []
        for role, names in self.parts:
            texts = [F.nullif(_text(record, n), F.lit("")) for n in names]
            turn = _turn(F.lit(role), F.concat_ws("\n\n", *texts))
            turns.append(F.when(F.coalesce(*texts).isNotNull(), turn) if role in self.optional else turn)
        return F.filter(F.array(*turns), lambda t: t.isNotNull())


@dataclass(frozen=True)
class Layout:
    name: str
    shapes: tuple           # examples of the fields that are read: {} objects, [] lists of them or empty, "" texts
    mapping: ListTurns | FieldTurns


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _items(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "array<variant>")


def _has(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "variant").isNotNull()


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _text(record: Column, path: str) -> Column:
    """A field's text, or that of its parts: strings, or objects with a text."""
    parts = F.transform(_items(record, path), lambda p: F.when(_is_object(p), F.try_variant_get(p, "$.text", "string"))
                        .otherwise(F.try_variant_get(p, "$", "string")))
    joined = F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), "\n\n")
    return F.coalesce(joined, F.try_variant_get(record, f"$.{path}", "string"))


# Speaker names of common conversation data sets and their canonical role.
SPEAKERS = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant",
            "chatbot": "assistant", "model": "assistant", "agent": "assistant"}

LAYOUTS = (
    Layout("turns", ({"turns": [{"role": "", "text": ""}]}, {"turns": []}),
           ListTurns("turns", "role", "text")),
    Layout("messages", ({"messages": [{"role": "", "content": ""}]}, {"messages": []},
                        {"messages": [{"role": "", "content": ""}], "prompt": ""}),     # the prompt is the first message
           ListTurns("messages", "role", "content", SPEAKERS)),
    Layout("system_messages", ({"messages": [{"role": "", "content": ""}], "system": ""}, {"messages": [], "system": ""}),
           ListTurns("messages", "role", "content", SPEAKERS, system="system")),
    Layout("from_value", ({"conversations": [{"from": "", "value": ""}]}, {"conversations": []}),
           ListTurns("conversations", "from", "value", SPEAKERS)),
    Layout("system_from_value", ({"conversations": [{"from": "", "value": ""}], "system": ""},),
           ListTurns("conversations", "from", "value", SPEAKERS, system="system")),
    Layout("dialogue", ({"dialogue": [{"speaker": "", "utterance": ""}]},),
           ListTurns("dialogue", "speaker", "utterance", SPEAKERS)),
    Layout("instruction_input", ({"instruction": "", "input": "", "output": ""},
                                 {"system": "", "instruction": "", "input": "", "output": ""}),
           FieldTurns((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))))),
    Layout("instruction", ({"instruction": "", "output": ""}, {"system": "", "instruction": "", "output": ""}),
           FieldTurns((("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",))))),
    Layout("instruction_response", ({"instruction": "", "response": ""},
                                    {"instruction": "", "context": "", "response": ""}),
           FieldTurns((("user", ("instruction", "context")), ("assistant", ("response",))))),
    Layout("prompt_completion", ({"prompt": "", "completion": ""}, {"system": "", "prompt": "", "completion": ""}),
           FieldTurns((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))))),
    Layout("prompt_response", ({"prompt": "", "response": ""}, {"system": "", "prompt": "", "response": ""}),
           FieldTurns((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))))),
    Layout("question_answer", ({"question": "", "answer": ""}, {"context": "", "question": "", "answer": ""}),
           FieldTurns((("user", ("context", "question")), ("assistant", ("answer",))))),
    Layout("nested_data", ({"data": {"prompt": "", "reply": ""}},),
           FieldTurns((("user", ("data.prompt",)), ("assistant", ("data.reply",))))),
)


def shape_paths(shape, prefix: str = "") -> list[str]:
    """Field paths of an example: ``a``, ``a.b`` in an object, ``a[].b`` in the objects of a list."""
    paths = []
    for name, inner in shape.items():
        at = f"{prefix}{name}"
        paths.append(at)
        if isinstance(inner, dict):
            paths += shape_paths(inner, f"{at}.")
        elif isinstance(inner, list):
            for item in inner:
                paths += shape_paths(item, f"{at}[].")
    return sorted(paths)


def signature(shape) -> str:
    return ", ".join(shape_paths(shape))


def read_paths(record: Column, layouts=LAYOUTS) -> Column:
    """The signature of a VARIANT record: those of its field paths that some layout reads, sorted."""
    known = sorted({p for lay in layouts for s in lay.shapes for p in shape_paths(s)})
    lists = {lay.mapping.path for lay in layouts if isinstance(lay.mapping, ListTurns)}

    def present(path: str) -> Column:
        base, _, inner = path.partition("[].")
        if inner:
            return F.exists(_items(record, base), lambda t: _has(t, inner))
        if path in lists:               # a list of objects that all have something to read, or no known layout
            inside = [p.partition("[].")[2] for p in known if p.startswith(f"{path}[].")]
            fits = F.forall(_items(record, path), lambda t: F.coalesce(
                _is_object(t) & F.coalesce(*[F.nullif(_has(t, p), F.lit(False)) for p in inside]), F.lit(False)))
            return F.when(F.coalesce(fits, F.lit(False)), F.lit(path)).when(_has(record, path), F.lit(f"{path}?"))
        return _has(record, path)

    marks = [present(p) if p in lists else F.when(present(p), F.lit(p)) for p in known]
    return F.array_join(F.array_compact(F.array(*marks)), ", ")


def fingerprint(record: Column, layouts=LAYOUTS) -> Column:
    return F.xxhash64(read_paths(record, layouts))


def all_paths_print(record: Column) -> Column:
    """Hash of all nested field paths of a VARIANT record: its schema without the leaf types."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record),
                                       r"(?<=: |ARRAY<|^)(?:DECIMAL\([0-9, ]+\)|TIMESTAMP_NTZ|[A-Z]+)(?=[,>]|$)", ""))


def canonical_turns(df: DataFrame, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """Adds ``layout`` (name or NULL), ``unknown_print`` (of a record whose layout is NULL; NULL for a NULL record) and
    ``turns`` (array of role, text) read from a VARIANT column."""
    print_, record = F.col("__print"), F.col(record_col)
    name = turns = None
    for lay in layouts:
        hit = F.array_contains(F.array(*[F.xxhash64(F.lit(signature(s))) for s in lay.shapes]), print_)
        name = F.when(hit, F.lit(lay.name)) if name is None else name.when(hit, F.lit(lay.name))
        value = F.coalesce(lay.mapping.turns(record), F.array().cast(TURN_TYPE))
        turns = F.when(hit, value) if turns is None else turns.when(hit, value)
    out = df.withColumn("__print", fingerprint(record, layouts))
    out = out.withColumn("__turns", turns.otherwise(F.array().cast(TURN_TYPE))).withColumn("__layout", name)
    unknown = F.when(F.col("__layout").isNull() & record.isNotNull(), all_paths_print(record))
    return (out.withColumn("__unknown", unknown).withColumn("layout", F.col("__layout"))
            .withColumn("unknown_print", F.col("__unknown")).withColumn("turns", F.col("__turns"))
            .drop("__print", "__turns", "__layout", "__unknown"))


# -- template -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``open`` role ``body`` text ``close``. ``reserved`` are further control strings of
    tokenizers that must not arise from a text. A control string begins with ``<`` or ``[`` and holds neither
    of them later; an escape puts one backslash after that first character (one more if there are some)."""
    open: str = "<|turn|>"
    body: str = "<|text|>"
    close: str = "<|end|>"
    # Control strings of public chat templates.
    reserved: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<SYS>>", "</SYS>>", "<|im_start|>", "<|im_end|>",
                       "<|endoftext|>", "<|startoftext|>")
    loss_role: str = "assistant"

    def _tails(self) -> str:
        marks = (self.open, self.body, self.close, *self.reserved)
        for m in marks:
            if m[0] not in "<[" or set(m[1:]) & set("<[\\"):
                raise ValueError(f"control string {m!r} can't be escaped")
        return "|".join(re.escape(m[1:]) for m in marks)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._tails()})", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self._tails()})", "$1$2$3")


def format_chat(df: DataFrame, turns_col: str = "turns", template: Template = Template()) -> DataFrame:
    """Adds ``formatted`` (string) and ``loss_spans`` (array of start, length in code points: the escaped texts of
    the loss role, in order)."""
    t = template
    safe = F.transform(F.coalesce(F.col(turns_col), F.array().cast(TURN_TYPE)), lambda x: F.struct(
        (x["role"] == t.loss_role).alias("loss"),
        F.concat(F.lit(t.open), t.escape(x["role"]), F.lit(t.body)).alias("head"),
        t.escape(x["text"]).alias("text")))
    out = df.withColumn("__safe", safe)
    sizes = F.transform("__safe", lambda x: F.length(x["head"]) + F.length(x["text"]) + len(t.close))
    placed = F.zip_with("__safe", running_sums(sizes), lambda x, before: F.struct(
        x["loss"].alias("loss"), F.struct((before + F.length(x["head"])).alias("start"), F.length(x["text"]).alias("length"))
        .alias("span")))
    spans = F.transform(F.filter(placed, lambda p: p["loss"]), lambda p: p["span"])
    text = F.array_join(F.transform("__safe", lambda x: F.concat(x["head"], x["text"], F.lit(t.close))), "")
    return out.withColumn("formatted", text).withColumn("loss_spans", spans).drop("__safe")


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text: the inverse of ``format_chat``."""
    t = template
    pieces = F.split(formatted, re.escape(t.close), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(p: Column) -> Column:
        two = F.split(p, re.escape(t.body), -1)
        return F.struct(t.unescape(F.substring(two[0], len(t.open) + 1, 2**31 - 1)).alias("role"),
                        t.unescape(two[1]).alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, loss_spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between. A span lies in one turn and a turn holds at
    most one, as ``format_chat`` gives them: spans are laid beside the turns by their starts, so that each is cut from
    its turn alone and not from the whole text."""
    t = template

    def placed(pieces: Column) -> Column:
        starts = running_sums(F.transform(pieces, lambda p: F.length(p) + len(t.close)))
        turns = F.zip_with(pieces, starts, lambda p, at: F.struct(
            at.alias("at"), F.lit(0).alias("kind"), p.alias("text"), F.length(p).alias("length")))
        spans = F.transform(loss_spans, lambda s: F.struct(
            s["start"].alias("at"), F.lit(1).alias("kind"), F.lit("").alias("text"), s["length"].alias("length")))
        return F.sort_array(F.concat(turns, spans))

    def cut(turn: Column, span: Column) -> Column:
        return F.when(span["kind"] == 1, t.unescape(F.substring(turn["text"], span["at"] - turn["at"] + 1, span["length"])))

    pieces = F.split(formatted, re.escape(t.close), -1)
    return let(let(pieces, placed), lambda rows: F.array_join(
        F.zip_with(rows, F.slice(rows, 2, F.size(rows)), cut), ""))


def records_of_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """One VARIANT record ``{"turns": [{turn, role, text}]}`` per conversation from rows by turn. Ties in ``turn``
    are ordered by role and text (NULLs first); repeated rows stay; rows without a conversation id are one
    conversation with a NULL id."""
    item = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                    F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("t"))
    return grouped.select("conv_id", F.to_variant_object(F.struct(F.col("t").alias("turns"))).alias("record"))


def format_digest(records: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what is read back from the formatted output of (conv_id, record)."""
    out = format_chat(canonical_turns(records, "record"), "turns", template)
    out = (out.select("conv_id", "formatted", "loss_spans")
           .withColumn("back", read_back(F.col("formatted"), template))
           .withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans"), template)))
    flat = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
