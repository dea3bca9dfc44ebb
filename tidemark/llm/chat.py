"""Chat formatting in Spark expressions: sort, merge, escape, concatenate, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template. No escaped text holds any of its marks, as every backslash,
# "#" and "<" of a text is written as a backslash and a letter.
HEAD = "### "
AFTER_ROLE = ":\n"
BETWEEN = "</part>\n"
END = "</turn>\n"
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]  # the last for roles alone


#: Numbers that are summed one after another in one array.
RUN = 128


def escape(text: Column, role: bool = False) -> Column:
    for plain, safe in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Undoes ``escape``: a letter after a backslash was never written by a text itself."""
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end in code points) of each conversation.

    ``turns`` has conv_id, turn, role and text. The turns of a conversation are sorted as
    structs: by turn (nulls first), ties by role and text, so any order of rows gives the
    same result, and repeated rows stay repeated. Adjacent turns of one role share a header;
    their texts are kept apart by a mark. The text of the ``trained`` roles is under the loss
    mask, marks are not. Null texts and roles are empty; rows with a null conv_id are one
    conversation; no rows give no rows; other columns are not read. A conversation is one
    row of the output, so its turns meet in one row.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    size = F.size("turns")
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    with_starts = sorted_turns.select("conv_id", "turns", starts.alias("starts"))

    def block(start: Column, k: Column) -> Column:
        """The turns from the start of a block to that of the next one."""
        after = F.coalesce(F.get(F.col("starts"), k + 1), size)
        own = F.transform(F.sequence(start, after - 1), lambda i: F.get(F.col("turns"), i)["text"])  # a slice copies all
        return F.struct(role_at(start).alias("role"), own.alias("texts"))

    merged = with_starts.select("conv_id", F.transform("starts", block).alias("blocks"))

    def block_pieces(b: Column) -> Column:
        """Pieces of a block in order; ``loss`` is set for text under the mask."""
        mask = b["role"].isin(*trained)
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        body = F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            part(F.when(i > 0, F.lit(BETWEEN)).otherwise(F.lit("")), F.lit(False)), part(escape(t), mask))))
        head = part(F.concat(F.lit(HEAD), escape(b["role"], role=True), F.lit(AFTER_ROLE)), F.lit(False))
        return F.concat(F.array(head), body, F.array(part(F.lit(END), F.lit(False))))

    laid = merged.select("conv_id", F.flatten(F.transform("blocks", block_pieces)).alias("pieces"))
    sized = laid.select("conv_id", "pieces", F.transform("pieces", lambda p: F.char_length(p["text"])).alias("lengths"))
    measured = sized.select("conv_id", "pieces", offsets(F.col("lengths")).alias("at"))

    def span(p: Column, i: Column) -> Column:
        start = F.get(F.col("at"), i)
        return F.struct(p["loss"].alias("loss"), start.alias("start"), (start + F.char_length(p["text"])).alias("end"))

    spans = F.filter(F.transform("pieces", span), lambda s: s["loss"] & (s["end"] > s["start"]))
    return measured.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
    )


def offsets(lengths: Column) -> Column:
    """The sum of all numbers before each one, for an array that is not empty.

    Appending to an array copies it, so sums are made in runs of ``RUN`` numbers, which start
    from the sums of the runs before them.
    """
    n = F.size(lengths)
    none = F.lit(0).cast("long")

    def upto(first: Column, places: Column, number) -> Column:
        """The first number, and its sums with the numbers of all places but the last."""
        return F.aggregate(places, F.array(first), lambda acc, i: F.when(F.size(acc) < F.size(places), F.array_append(acc, F.element_at(acc, -1) + number(i))).otherwise(acc))

    starts = F.sequence(F.lit(0), n - 1, F.lit(RUN))
    run = lambda s: F.sequence(s, F.least(s + RUN, n) - 1)
    total = lambda s: F.aggregate(run(s), none, lambda acc, i: acc + F.get(lengths, i))
    return F.flatten(F.zip_with(starts, upto(none, starts, total), lambda s, first: upto(first, run(s), lambda i: F.get(lengths, i))))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: what ``format_chats`` was given, from its output."""
    blocks = F.transform(
        F.filter(F.split("formatted", END, -1), lambda b: b != ""),
        lambda b: F.struct(
            unescape(F.substring_index(F.substring(b, len(HEAD) + 1, 2147483647), AFTER_ROLE, 1)).alias("role"),
            F.split(_after(b), BETWEEN, -1).alias("texts"),
        ),
    )
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.transform(_cuts(F.col("formatted"), F.col("loss_spans")), unescape), "")
    return formatted.select("conv_id", blocks.alias("blocks"), loss.alias("loss_text"), "formatted").select("conv_id", turns.alias("turns"), "loss_text", "formatted")


def _cuts(text: Column, spans: Column) -> Column:
    """The pieces of a text at spans in ascending order.

    A cut goes through the text from its start, so runs of spans are cut out first, and the
    spans out of those.
    """
    n = F.size(spans)

    def run(first: Column) -> Column:
        last = F.least(first + RUN, n) - 1
        start = F.get(spans, first)["start"]
        cut = F.substring(text, (start + 1).cast("int"), (F.get(spans, last)["end"] - start).cast("int"))
        return F.struct(cut.alias("text"), start.alias("start"), first.alias("first"), last.alias("last"))

    def cut(r: Column, i: Column) -> Column:
        span = F.get(spans, i)
        return F.substring(r["text"], (span["start"] - r["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(F.transform(starts, run), lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: cut(r, i))))


def _after(block: Column) -> Column:
    """A block without its header line."""
    return F.substring(block, (F.instr(block, AFTER_ROLE) + len(AFTER_ROLE)).cast("int"), F.lit(2147483647))
