"""The op log: replay, time travel, digests and tamper checks as windows over ``seq``."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("add", "update", "delete", "add_edge", "delete_edge", "delete_edges_touching")
FIRST = "0" * 64
#: Stands for the hash of the line before in a line that waits for it.
MARK = "to be chained"


def _until(journal: DataFrame, seq: int | None) -> DataFrame:
    known = F.col("op").isin(*KINDS)
    journal = journal.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("boolean")))
    return journal if seq is None else journal.where(F.col("seq") <= seq)


def replay(journal: DataFrame, until: int | None = None, columns: tuple[str, ...] = ("content", "user_id")) -> DataFrame:
    """The records after the log, or after its part up to ``until``: of each id what stood last, since its last add, unless it was deleted later."""
    ops = _until(journal, until).where(F.col("op").isin("add", "update", "delete"))
    own = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = ops.withColumn("_add", F.max(F.when(F.col("op") == "add", F.col("seq"))).over(own)).withColumn("_gone", F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(own))
    live = marked.where((F.col("seq") >= F.col("_add")) & (F.col("_gone").isNull() | (F.col("_gone") < F.col("_add"))))
    return live.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in columns], F.max("seq").alias("last_seq"))


def embedded_texts(journal: DataFrame, until: int | None = None) -> DataFrame:
    """journal: also ``reembed`` (null: true). id, content, embedded: of each live record its text after the log, and the text that its vector was made of.

    An update of the text that kept the vector (``reembed`` false) leaves that of the text before; ``models.embed`` over
    ``embedded`` gives the live vectors.
    """
    ops = _until(journal, until)
    fresh = (F.col("op") == "add") | F.coalesce(F.col("reembed"), F.lit(True))
    marked = ops.withColumn("embedded", F.when(F.col("op").isin("add", "update") & fresh, F.col("content")))
    return replay(marked, columns=("content", "embedded")).select("id", "content", "embedded")


def replay_edges(journal: DataFrame, until: int | None = None) -> DataFrame:
    """The edges after the log: gone are those deleted by id, and those with an end deleted, later than they were added."""
    ops = _until(journal, until)
    added = ops.where(F.col("op") == "add_edge").select("id", "from_id", "to_id", "relation", "seq")
    by_id = ops.where(F.col("op") == "delete_edge").groupBy("id").agg(F.max("seq").alias("cut"))
    ends = ops.where(F.col("op").isin("delete", "delete_edges_touching")).groupBy(F.col("id").alias("end")).agg(F.max("seq").alias("end_cut"))
    out = added.join(by_id, "id", "left").where(F.col("cut").isNull() | (F.col("cut") < F.col("seq"))).drop("cut")
    for side in ("from_id", "to_id"):
        out = out.join(ends.withColumnRenamed("end", side), side, "left").where(F.col("end_cut").isNull() | (F.col("end_cut") < F.col("seq"))).drop("end_cut")
    return out.select("id", "from_id", "to_id", "relation")


def digest(rows: DataFrame, columns: tuple[str, ...], by: str = "id") -> DataFrame:
    """One row: the number of rows and a digest of all of them, whatever their order.

    Each row's SHA-256 is cut into four numbers that are summed over all rows, so that no task sees the whole.
    """
    line = F.sha2(F.to_json(F.struct(by, *columns), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(line, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[part(k) for k in range(8)]), 256).alias("digest"))


def line_hash(before: str, line: dict, key: bytes | None = None) -> str:
    """The hash that ties a line to the one before: SHA-256, or HMAC with a key, over the line and that hash in canonical JSON."""
    body = json.dumps({k: v for k, v in line.items() if k != "line_hash"} | {"prev_hash": before}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    return hmac.new(key, body, hashlib.sha256).hexdigest() if key else hashlib.sha256(body).hexdigest()


def append(lines: list[dict], ops: list[dict], key: bytes | None = None) -> list[dict]:
    """The log with more ops, numbered on and chained; appending is one writer's work."""
    out = list(lines)
    for op in ops:
        line = op | {"seq": out[-1]["seq"] + 1 if out else 1}
        out.append(line | {"line_hash": line_hash(out[-1]["line_hash"] if out else FIRST, line, key)})
    return out


class Journal:
    """A log file that one writer at a time appends to, a JSON line for each op; writers of several processes wait for one another."""

    def __init__(self, path: str, key: bytes | None = None):
        self.path, self.key = path, key

    def append(self, ops: list[dict]) -> int:
        """Writes the ops behind the file's last whole line; a torn one goes. The number of the last line."""
        import fcntl
        import os

        with open(f"{self.path}.lock", "w") as lock, open(self.path, "ab+") as f:
            fcntl.flock(lock, fcntl.LOCK_EX)
            # the last line alone is read, from the end
            end, tail = f.seek(0, 2), b""
            while end and tail.count(b"\n") < 2:
                step = min(end, 1 << 16)
                end -= step
                f.seek(end)
                tail = f.read(step) + tail
            whole = tail[: tail.rfind(b"\n") + 1]
            f.truncate(end + len(whole))
            last = [json.loads(whole.splitlines()[-1])] if whole else []
            made = append(last, ops, self.key)[len(last) :]
            f.seek(0, 2)
            f.write("".join(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n" for x in made).encode())
            f.flush()
            os.fsync(f.fileno())
        return made[-1]["seq"] if made else last[-1]["seq"] if last else 0


def canonical(values: dict[str, Column]) -> Column:
    """The canonical JSON of a line with these values, by name, as ``line_hash`` makes it; nulls are shown."""
    return F.to_json(F.struct(*[values[k].alias(k) for k in sorted(values)]), {"ignoreNullFields": "false"})


def broken_lines(lines: DataFrame, values: dict[str, Column]) -> DataFrame:
    """lines: seq, line_hash, and what ``values`` (the line's other parts by name) are made of. seq, fault of each line that isn't what its writer chained: a number missing before it, or another hash.

    Every line is held against the stored hash of the line before it, by a join on seq - 1: a chain is whole exactly if
    each of its links is, so the links are checked side by side.
    """
    before = lines.select((F.col("seq") + 1).alias("seq"), F.col("line_hash").alias("_before"))
    out = lines.join(before, "seq", "left")
    gap = (F.col("seq") != 1) & F.col("_before").isNull()
    hashed = F.sha2(canonical(values | {"seq": F.col("seq"), "prev_hash": F.coalesce("_before", F.lit(FIRST))}), 256)
    return out.select("seq", F.when(gap, "gap").when(~F.coalesce(hashed == F.col("line_hash"), F.lit(False)), "hash").alias("fault")).where("fault is not null")


def chained(ops: DataFrame, values: dict[str, Column]) -> DataFrame:
    """ops: seq (1, 2, ...) and what ``values`` are made of, as a log of one scope: adds line_hash. A chain is one after another, so this folds in one task, over the canonical JSON of each line only."""
    import pandas as pd

    def fold(rows):
        before, made = FIRST, []
        rows = rows.sort_values("seq")
        for line in rows["line"]:
            before = hashlib.sha256(line.replace(f'"prev_hash":"{MARK}"', f'"prev_hash":"{before}"').encode()).hexdigest()
            made.append(before)
        return pd.DataFrame({"seq": rows["seq"], "line_hash": made})

    line = canonical(values | {"seq": F.col("seq"), "prev_hash": F.lit(MARK)})
    found = ops.select("seq", line.alias("line")).groupBy(F.lit(0).alias("all")).applyInPandas(lambda rows: fold(rows), "seq bigint, line_hash string")
    return ops.join(found, "seq")


def journaled(old: DataFrame, new: DataFrame, columns: tuple[str, ...], first_seq: int = 1) -> DataFrame:
    """The ops that lead from one table of records to another: op, id, columns, seq. A record that is new is added, one that is gone deleted, one that differs updated with what differs."""
    differs = [(~F.col(f"_{c}").eqNullSafe(F.col(c))) for c in columns]
    both = old.select("id", F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in columns]).join(new.select("id", F.lit(True).alias("_new"), *columns), "id", "full")
    any_differs = differs[0]
    for x in differs[1:]:
        any_differs = any_differs | x
    op = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "delete").when(any_differs, "update")
    shown = [F.when(op == "add", F.col(c)).when((op == "update") & d, F.col(c)).alias(c) for c, d in zip(columns, differs)]
    ops = both.select(op.alias("op"), "id", *shown).where("op is not null")
    # numbers by id, counted by range: no task numbers the whole log
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    dealt = ops.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 64 rows
    numbered = dealt.join(F.broadcast(sizes), "_part").withColumn("seq", F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy("id")) + F.lit(first_seq - 1))
    return numbered.select("op", "id", *columns, "seq")


def verified(journal: DataFrame, live: DataFrame, columns: tuple[str, ...], faults: DataFrame) -> DataFrame:
    """One row: whether the log is whole (no ``faults``, and not empty) and the state that it leads to is the live one, by digest."""
    mine, theirs = digest(replay(journal, columns=columns), columns), digest(live, columns)
    state = mine.select(F.col("digest").alias("a")).crossJoin(theirs.select(F.col("digest").alias("b")))  # one row each
    return state.crossJoin(faults.agg(F.count("*").alias("n_faults"))).crossJoin(journal.agg(F.count("*").alias("n_lines"))).select(
        "n_lines", "n_faults", (F.col("a") == F.col("b")).alias("same_state"), ((F.col("n_lines") > 0) & (F.col("n_faults") == 0) & (F.col("a") == F.col("b"))).alias("verified")
    )


def read_text(rows: DataFrame) -> DataFrame:
    """rows: n (line number), value (a JSON line). The ops; a broken last line (a torn write) is dropped, any other is an error."""
    last = rows.agg(F.max("n").alias("last_n"))
    parsed = rows.join(F.broadcast(last)).withColumn("whole", F.json_object_keys("value").isNotNull())  # one row
    torn = F.col("n") == F.col("last_n")
    broken = F.raise_error(F.format_string("journal line %d is broken", "n")).cast("boolean")
    return parsed.where(F.when(F.col("whole"), True).when(torn, False).otherwise(broken)).select("n", "value")


def chain_breaks(lines: DataFrame) -> DataFrame:
    """lines: seq, before_hash (that the line was chained to), line_hash. The lines whose number or chain doesn't follow the line before.

    ``seq`` is dense, so a line's predecessor is found by a join on seq - 1 rather than by one window over all lines.
    """
    before = lines.select((F.col("seq") + 1).alias("seq"), F.col("line_hash").alias("found"), F.lit(True).alias("follows"))
    out = lines.join(before, "seq", "left").withColumn("expected", F.when(F.col("seq") == 1, FIRST).otherwise(F.col("found")))
    gap = (F.col("seq") != 1) & F.col("follows").isNull()
    return out.where(gap | ~F.coalesce(F.col("before_hash") == F.col("expected"), F.lit(False))).select("seq", F.when(gap, "gap").otherwise("chain").alias("fault"))


def verify(lines: list[dict], key: bytes | None = None, checkpoint: tuple[int, str] | None = None) -> tuple[bool, str]:
    """Whether a log is whole: numbers without gaps, every hash over its line, and a known line where a checkpoint says. An empty log proves nothing; lines without hashes end the proof."""
    if not lines:
        return False, "empty: nothing is proven"
    before = FIRST
    for n, line in enumerate(lines, 1):
        if line.get("seq") != n:
            return False, f"line {n} has number {line.get('seq')}"
        if "line_hash" not in line:
            return True, f"line {n} has no hash; not proven from there"
        if not hmac.compare_digest(line["line_hash"], line_hash(before, line, key)):
            return False, f"line {n} was changed"
        before = line["line_hash"]
        if checkpoint and checkpoint[0] == n and checkpoint[1] != before:
            return False, f"line {n} differs from the checkpoint"
    if checkpoint and checkpoint[0] > len(lines):
        return False, "the log is shorter than the checkpoint"
    return True, "whole"
