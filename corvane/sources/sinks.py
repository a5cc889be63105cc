"""Sinks (SNK-1 to 17, SET-8, FLT-20)."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators.labels import new_labels
from corvane.operators.rank import first_by

from . import sequence


def append_log(rows: DataFrame, path: str) -> int:
    """SNK-1: a run's rows, in their order, added to a log as an epoch of their own."""
    return sequence.append(rows, path)


def append_receipts(rows: DataFrame, path: str) -> None:
    """SNK-2: receipts added; a missing field ends the write."""
    need = ("candidate_arxiv", "run_id", "ts", "primitive", "state_bytes", "confidence", "latency_ms", "model_version")
    checked = rows
    for c in need:
        checked = checked.withColumn(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c)).otherwise(F.raise_error(F.lit(f"receipt without {c}"))))
    append_log(checked, path)


def write_posted(state: DataFrame, path: str, version: int, updated: str) -> None:
    """SNK-4: the posted state (id, turn, pos: at most 2000 ids by then) as one JSON line in a version of its own.

    A version shows only once Spark has committed it, and an older one stays, so a lost job leaves the state as it was.
    """
    ids = F.transform(F.array_sort(F.collect_list(F.struct("turn", "pos", "id"))), lambda x: x["id"])
    state.agg(ids.alias("posted")).withColumn("updated", F.lit(updated)).coalesce(1).write.mode("error").json(f"{path}/v={version}")


def append_labels(rows: DataFrame, ledger: DataFrame, path: str) -> int:
    """SNK-3: writes the labels that the ledger lacks; returns how many."""
    new = new_labels(rows, ledger).persist()
    try:
        new.write.mode("append").parquet(path)
        return new.count()
    finally:
        new.unpersist()


def note_lines(picks: DataFrame) -> DataFrame:
    """SNK-5: a digest note's checkbox line for each pick, in order."""
    return picks.select("place", F.concat(F.lit("- [ ] "), "title", F.lit(" — [arXiv:"), "id", F.lit("](https://arxiv.org/abs/"), "id", F.lit(") · "), "why").alias("line"))


def vault_note(picks: DataFrame, day: str, feed: str, mode: str) -> DataFrame:
    """SNK-5: the note as one row (a report of the picks)."""
    lines = note_lines(picks).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("l"))
    body = F.when(F.col("l") == "", "- nothing matched your profile today").otherwise(F.col("l"))
    return lines.select(F.concat(F.lit(f"---\ntype: digest\ndate: {day}\nfeed: {feed}\nmode: {mode}\n---\n# arXiv {feed} picks — {day}\n\n`{mode}`\n\n"), body, F.lit("\n")).alias("value"))


def messages(picks: DataFrame, total: int, day: str, mode: str) -> DataFrame:
    """SNK-6: a chat message for each pick."""
    head = F.concat(F.lit("*pick "), F.col("place").cast("string"), F.lit(f"/{total} for {day}* — {mode}\n<http://arxiv.org/abs/"), "id", F.lit("|"), text.mrkdwn(F.col("title")), F.lit(">\n   _why:_ "), "why")
    return picks.select("id", "place", head.alias("text"))


def digest_text(picks: DataFrame, day: str, feed: str, mode: str) -> DataFrame:
    """SNK-7."""
    line = F.concat(F.col("place").cast("string"), F.lit(". <http://arxiv.org/abs/"), "id", F.lit("|"), "title", F.lit(">\n   _why:_ "), "why")
    got = picks.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("l"))
    return got.select(F.concat(F.lit(f"*arXiv {feed} picks for {day}* ("), F.col("n").cast("string"), F.lit(f")\n_{mode}_\n"), F.when(F.col("n") == 0, "_nothing matched your profile today_").otherwise(F.col("l"))).alias("value"))


SINKS = ("stdout", "vault", "slack")


def parse_sinks(names: str) -> tuple[str, ...]:
    """SET-8: a comma-joined choice of sinks; unknown, empty or contradictory choices raise."""
    got = tuple(dict.fromkeys(x.strip() for x in names.split(",") if x.strip()))
    if not got or (bad := [x for x in got if x not in (*SINKS, "none")]) or ("none" in got and len(got) > 1):
        raise ValueError(f"unknown or contradictory sinks: {names!r}" if got else "no sink is named")
    return () if got == ("none",) else got


def fan_out(picks: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], durable: tuple[str, ...] = ("vault", "slack")) -> tuple[dict[str, str | None], bool]:
    """SNK-8: all sinks get one ranking; a failure stays its own.  Returns errors by sink and whether ids count as posted."""
    kept, errors = picks.persist(), {}
    try:
        for name, write in sinks.items():
            try:
                write(kept)
                errors[name] = None
            except Exception as e:  # noqa: BLE001  reported, and the other sinks still run
                errors[name] = f"{type(e).__name__}: {e}"
    finally:
        kept.unpersist()
    return errors, any(errors.get(n, "") is None for n in durable)


def staged_notes(hits: DataFrame, existing: DataFrame, day: str) -> DataFrame:
    """SNK-9 to 11, STR-9, 22: new notes (file, value) for hits (arxiv, title, authors, why) that no note owns; equal slugs get numbers.

    Of several hits of an id, the first by title, then why, counts; an id is needed, a missing title or why is empty.
    """
    from pyspark.sql import Window

    hits = hits.where("arxiv IS NOT NULL").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "why")})
    new = first_by(hits, ["arxiv"], F.col("title"), F.col("why")).join(existing.select("arxiv"), "arxiv", "left_anti").withColumn("slug", text.slug(F.col("title")))
    k = F.row_number().over(Window.partitionBy("slug").orderBy("arxiv"))
    name = F.concat(F.lit(f"paper-{day.replace('-', '')}-"), "slug", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), F.lit(".md"))
    quote = lambda c: F.concat(F.lit('"'), text.yaml_scalar(F.col(c)), F.lit('"'))
    body = F.concat(F.lit("---\ntype: paper\nstatus: staged\narxiv: "), "arxiv", F.lit("\ntitle: "), quote("title"), F.lit("\nwhy: "), quote("why"), F.lit(f"\ndate: {day}\n---\n"))
    return new.select(name.alias("file"), body.alias("value"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-13, 14: rows of old, those of new in place of equal keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def repaired_titles(notes: DataFrame, titles: DataFrame) -> DataFrame:
    """SNK-17: placeholder titles replaced by fetched ones."""
    got = notes.join(titles.select("arxiv", F.col("title").alias("_t")), "arxiv", "left")
    return got.withColumn("title", F.when(F.col("title").startswith("arXiv:"), F.coalesce("_t", "title")).otherwise(F.col("title"))).drop("_t")


def enrich(payload: str, command: str, cap: int = 4096, timeout: float = 60.0) -> str | None:
    """SNK-15: what a command says to the picks' JSON, up to cap characters; null if it fails."""
    try:
        return subprocess.run(command, shell=True, input=payload, capture_output=True, text=True, timeout=timeout, check=True).stdout[:cap]
    except (subprocess.SubprocessError, OSError):
        return None


def render_report(sections: dict[str, DataFrame], most: int = 50) -> str:
    """SNK-16: metric tables as text; a table of more rows than most says so."""
    out = []
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        out += [f"## {name}", *("  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows[:most]), *(["(more rows)"] if len(rows) > most else []), ""]
    return "\n".join(out)


def valid_lane(name: str) -> bool:
    """FLT-20."""
    return re.fullmatch(r"[a-z0-9][a-z0-9-]{0,31}", name) is not None


def valid_channel(value: str) -> bool:
    return re.fullmatch(r"[CGD]0[0-9A-Z]{6,}", value) is not None


def valid_id(value: str) -> bool:
    return re.fullmatch(r"[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?|[a-z-]+/[0-9]{7}(v[0-9]+)?", value) is not None
