r"""Chat formatting by grammar round trip. DataFrame operations only.

Grammar: conversation = turn*; turn = "### " role ": " text "</turn>" LF. A deterministic parser reads it back: cut at every
terminator, the role ends at the first ": ". Control strings inside contents are errors, and so is a backslash that starts no escape.
Each turn is rendered as it is, reparsed and compared with its source; where they differ its contents are escaped
(``\`` as ``\\``, ``</turn>`` as ``\e``, ``### `` as ``\h``, and in roles ``: `` as ``\c``) and rendered again; an escaped content holds no control
string, so this settles. The whole rendered conversation is reparsed in the end, and what is returned is read from that.

The loss mask is a list of spans (start from 0, length, in code points of the rendered text), one for each text of an assistant.

Defined results: a null text or role counts as empty; turns with equal or null numbers (nulls first) are ordered by role and text; a null
conversation id is a conversation; repeated rows are turns of their own; an empty table gives an empty one. A conversation's turns
are held in one row, so that its text is bounded by a row's two gigabytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
END = CLOSE + "\n"
LEARNED_ROLE = "assistant"


def escape(content: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(content, F.lit("\\"), F.lit("\\\\")), F.lit(CLOSE), F.lit("\\e")), F.lit(OPEN), F.lit("\\h"))
    return F.replace(out, F.lit(COLON), F.lit("\\c")) if role else out


def unescape(content: Column) -> Column:
    """The inverse of :func:`escape`, or null where the grammar has no such content. Doubled backslashes pair up from the left."""
    marks = {"\\e": CLOSE, "\\h": OPEN, "\\c": COLON}

    def piece(x: Column) -> Column:
        for mark, string in marks.items():
            x = F.replace(x, F.lit(mark), F.lit(string))
        return x

    valid = ~F.contains(content, F.lit(CLOSE)) & ~F.contains(content, F.lit(OPEN)) & ~F.regexp_like(content, F.lit(r"(?<!\\)(?:\\\\)*\\(?![\\ehc])"))
    return F.when(valid, F.array_join(F.transform(F.split(content, r"\\\\"), piece), "\\"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(COLON), text, F.lit(END))


def parse_turn(turn: Column) -> Column:
    """struct(role, text) of a rendered turn without its terminator; nulls for what isn't in the grammar."""
    colon = F.locate(COLON, turn, 1) if isinstance(turn, str) else F.position(F.lit(COLON), turn)
    good = F.startswith(turn, F.lit(OPEN)) & (colon > 0)
    start = F.lit(len(OPEN) + 1)
    return F.struct(F.when(good, unescape(F.substr(turn, start, colon - start))).alias("role"), F.when(good, unescape(F.substr(turn, colon + F.lit(len(COLON))))).alias("text"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parse_turn)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, turns (as reparsed), loss_spans, exact (the reparse equals the source)."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    raw = parse_turn(F.concat(F.lit(OPEN), "role", F.lit(COLON), "text"))
    rows = rows.withColumn("same", F.coalesce((raw["role"] == F.col("role")) & (raw["text"] == F.col("text")), F.lit(False)))
    rows = rows.withColumns({"head": F.when(F.col("same"), F.col("role")).otherwise(escape(F.col("role"), role=True)), "body": F.when(F.col("same"), F.col("text")).otherwise(escape(F.col("text")))})
    rows = rows.withColumn("piece", render(F.col("head"), F.col("body")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sofar = F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"at": F.row_number().over(order), "span": F.struct((sofar - F.length("body") - len(END)).cast("long").alias("start"), F.length("body").cast("long").alias("length"))})
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "piece", "span"))).alias("c"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("c", lambda x: x["piece"]), ""))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("c", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    spans = F.transform(F.filter("c", lambda x: x["role"] == LEARNED_ROLE), lambda x: x["span"])
    return whole.select("conv_id", "formatted", "turns", spans.alias("loss_spans"), F.equal_null("turns", source).alias("exact"))


def digests(chats: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the rendered text and its mask."""
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    rows = chats.withColumn("masked", F.array_join(masked, ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "exact",
    )
