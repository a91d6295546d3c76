"""Chat formatting by schema fingerprints.

A record is one value of any shape. A schema fingerprint is a hash of nested field paths. A record has one for each declared layout: of those of its paths
that the layout names (other keys may be data, so they do not count). A map from the layouts' own fingerprints, made in the plan, gives the layouts whose paths the record has
all, and the first of them says where the turns' roles and texts are. Records become canonical turns, turns become one formatted string with a run-length loss mask. Everything is a column expression over variants, in one pass.

Template: `<turn ROLE>TEXT</turn>` and a line feed. In roles and texts `\\` is written `\\b`, `<` is `\\l` and `>` is `\\g`,
so no control string can stand inside a text and reading back is exact. The mask has three runs a turn: header, text, footer; the
texts of assistants are under it.

Defined results: null texts and roles are empty strings; rows of a conversation that tie by turn are ordered by role,
then text; a null conv_id is a conversation of its own; an empty table gives an empty result; a record that no layout
fits has null turns and is reported by layout = null, never dropped. Columns beside the named ones do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURNS = "array<struct<role:string,text:string>>"
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
@dataclass(frozen=True)
class Layout:
    """Where turns are. Either fixed (role, path) pairs, or a list of messages with a role and a text field."""

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""
    roles: dict = field(default_factory=dict, hash=False)
    parts: str = ""

    def paths(self) -> tuple[str, ...]:
        if self.messages:
            text = f"{self.messages}[].{self.text}" + (f"[].{self.parts}" if self.parts else "")
            return (f"{self.messages}[].{self.role}", text)
        if self.role:
            return (self.role, self.text)
        return tuple(p for _, p in self.fixed)


#: The first layout whose paths a record has is taken, so longer ones come first.
LAYOUTS = (
    Layout("message parts", messages="messages", role="role", text="content", parts="text"),
    Layout("messages", messages="messages", role="role", text="content"),
    Layout("from and value", messages="conversations", role="from", text="value", roles=ROLE_NAMES),
    Layout("turn list", messages="turns", role="role", text="text"),
    Layout("system instruction", fixed=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", fixed=(("user", "instruction"), ("user+", "input"), ("assistant", "output"))),
    Layout("instruction", fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction and response", fixed=(("user", "instruction"), ("assistant", "response"))),
    Layout("prompt and response", fixed=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question and answer", fixed=(("user", "question"), ("assistant", "answer"))),
    Layout("turn row", role="role", text="text"),
)


def _has(v: Column, path: str) -> Column:
    """Whether a variant has the leaf path; a[].b holds if some element of a has b. A null is a leaf, an object or a list is none."""
    outer, found, inner = path.partition("[].")
    at = F.try_variant_get(v, f"$.{outer}", "array<variant>" if found else "variant")
    if found:
        return F.coalesce(F.exists(at, lambda x: _has(x, inner)), F.lit(False))
    return at.isNotNull() & ~F.coalesce(F.schema_of_variant(at).rlike("^(OBJECT|ARRAY)<"), F.lit(False))


def paths() -> list[str]:
    """The paths that layouts name."""
    return sorted({p for x in LAYOUTS for p in x.paths()})


def present(record: Column) -> Column:
    """The paths that layouts name and the record has, in order."""
    return F.array_compact(F.array(*[F.when(_has(record, p), F.lit(p)) for p in paths()]))


def fingerprint(own: Column) -> Column:
    """The hash of a list of paths in order."""
    return F.xxhash64(F.array_join(own, "\n"))


def fingerprints(own: Column) -> Column:
    """Of the paths that a record has, the fingerprint under each layout."""
    return F.array(*[fingerprint(F.filter(F.array(*[F.lit(p) for p in sorted(x.paths())]), lambda p: F.array_contains(own, p))) for x in LAYOUTS])


def select_layout(own: Column) -> Column:
    """The name of the first layout whose paths are all present; null if there is none."""
    known = F.create_map(*[y for i, x in enumerate(LAYOUTS) for y in (fingerprint(F.array(*[F.lit(p) for p in sorted(x.paths())])), F.lit(i))])
    place = F.array_min(F.transform(fingerprints(own), lambda f: F.try_element_at(known, f)))
    return F.get(F.array(*[F.lit(x.name) for x in LAYOUTS]), place)


def _role(raw: Column, names: dict) -> Column:
    raw = F.coalesce(raw, F.lit(""))
    if not names:
        return raw
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(raw)), raw)


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def _turns(v: Column, x: Layout) -> Column:
    """The canonical turns of a record under one layout."""
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if x.messages:
        rows = _at(v, x.messages, "array<variant>")

        def one(m: Column) -> Column:
            text = _at(m, x.text)
            if x.parts:  # a text that is a plain string among lists of parts stays as it is
                text = F.coalesce(F.array_join(F.transform(_at(m, x.text, "array<variant>"), lambda p: F.coalesce(_at(p, x.parts), F.lit(""))), ""), text)
            return turn(_role(_at(m, x.role), x.roles), text)

        return F.transform(rows, one)
    if x.role:
        return F.array(turn(_role(_at(v, x.role), x.roles), _at(v, x.text)))
    out: list[list] = []
    for role, path in x.fixed:
        if role.endswith("+"):  # joins the turn before it, where it is not empty
            more = F.coalesce(_at(v, path), F.lit(""))
            out[-1][1] = F.concat(F.coalesce(out[-1][1], F.lit("")), F.when(more == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), more)))
        else:
            out.append([F.lit(role), _at(v, path)])
    return F.array(*[turn(r, t) for r, t in out])


def canonical(records: DataFrame, record: str) -> DataFrame:
    """records with layout and turns in place of the variant column record."""
    # Through a list of one, so that the paths are looked for once and not for every layout.
    held = records.withColumn("_layout", F.get(F.transform(F.array(present(F.col(record))), select_layout), F.lit(0)))
    turns = F.lit(None).cast(TURNS)
    for x in LAYOUTS:
        turns = F.when(F.col("_layout") == x.name, _turns(F.col(record), x)).otherwise(turns)
    return held.withColumn("turns", turns).withColumnRenamed("_layout", "layout").select(*[c for c in records.columns if c != record], "layout", "turns")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def formatted(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">"), escape(t["text"]), F.lit("</turn>\n"))), "")


def loss_runs(turns: Column) -> Column:
    """(chars, loss) runs over the formatted string: header, text and footer of each turn."""
    run = lambda n, loss: F.struct(n.cast("int").alias("chars"), loss.alias("loss"))
    runs = F.transform(turns, lambda t: F.array(
        run(F.char_length(escape(t["role"])) + 7, F.lit(False)), run(F.char_length(escape(t["text"])), t["role"] == "assistant"), run(F.lit(8), F.lit(False)),
    ))
    return F.flatten(runs)


def read_turns(output: Column) -> Column:
    """The turns of a formatted string."""
    whole = F.split(output, "</turn>\n")
    pieces = F.transform(F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))), lambda p: F.split(p, "[<>]"))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substr(F.get(p, F.lit(1)), F.lit(6))).alias("role"), unescape(F.get(p, F.lit(2))).alias("text")))


def read_loss(output: Column, runs: Column) -> Column:
    """The text under the mask, cut from the output by the runs, unescaped.

    The output is cut at its footers once; each turn's header, text and footer must have the lengths of its three runs, and only its text may be under the mask. All else is an error.
    """

    def turn(piece: Column, own: Column) -> Column:
        head, text, foot = (F.get(own, F.lit(k)) for k in range(3))
        parts = F.split(piece, "[<>]")
        body = F.get(parts, F.lit(2))
        fits = (F.size(parts) == 3) & (text["chars"] == F.char_length(body)) & (head["chars"] == F.char_length(piece) - F.char_length(body)) & (foot["chars"] == 8) & ~head["loss"] & ~foot["loss"]
        wrong = F.raise_error(F.lit("a run of the loss mask is not a text")).cast("string")
        return F.when(~F.coalesce(fits, F.lit(False)), wrong).when(text["loss"], body).otherwise(F.lit(""))

    def whole(x: Column) -> Column:
        turns = F.size(x["cut"]) - 1
        fits = (F.size(x["runs"]) == 3 * turns) & (F.element_at(x["cut"], -1) == "")
        texts = F.transform(F.slice(x["cut"], F.lit(1), turns), lambda piece, i: turn(piece, F.slice(x["runs"], 3 * i + 1, F.lit(3))))
        return F.when(fits, F.array_join(texts, "")).otherwise(F.raise_error(F.lit("loss mask and output differ in length")).cast("string"))

    # Through a list of one, so that the output is cut once and not for every turn.
    return unescape(F.get(F.transform(F.array(F.struct(F.split(output, "</turn>\n").alias("cut"), runs.alias("runs"))), whole), F.lit(0)))


def format_records(records: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_runs from records of conv_id, turn and a variant `record`, which holds one turn or a whole conversation."""
    turns = canonical(records.select("conv_id", "turn", "record"), "record")
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "turns"))).alias("_all"))
    gathered = gathered.select("conv_id", F.flatten(F.transform("_all", lambda x: F.coalesce(x["turns"], F.array().cast(TURNS)))).alias("turns"))
    return gathered.select("conv_id", formatted(F.col("turns")).alias("formatted"), loss_runs(F.col("turns")).alias("loss_runs"))


def format_rows(rows: DataFrame) -> DataFrame:
    """format_records of rows of conv_id, turn, role, text."""
    return format_records(rows.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record")))


PROBE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table's rows are of the layout "turn row"; the probe comes as one record of prompt and response.
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.to_variant_object(F.struct("role", "text")).alias("record"))
    probe = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.to_variant_object(F.struct(F.lit(PROBE).alias("prompt"), F.lit(PROBE).alias("response"))).alias("record"))
    out = format_records(rows.unionByName(probe)).withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", read_loss(F.col("formatted"), F.col("loss_runs")))
    digest = F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return out.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), digest.alias("turns_sha256"), F.char_length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


QUERIES = {"op4_chat_format": op4_chat_format}

ORACLES = {
    "op4_chat_format": r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
sized AS (
  SELECT *, 15 + len(role) + len(text) + len(role) - len(regexp_replace(role, '[\\<>]', '', 'g'))
    + len(text) - len(regexp_replace(text, '[\\<>]', '', 'g')) AS chars FROM rows_in),
joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""
}
