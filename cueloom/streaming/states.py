"""What is carried from batch to batch: the state of runs, and the terms that a medium's annotations have used."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cueloom.functions import text as T

# Which kinds of events decide a run's status, its failed step and its current step.
_DECIDE = {"status": ("running", "failed", "interrupted", "done"), "failed": ("running", "failed", "interrupted"), "current": ("running", "done")}
_RUN_STATE = ", ".join(f"{part}_seq long, {part}_kind string, {part}_step string" for part in _DECIDE) + ", completed array<string>"


def run_states(events: DataFrame) -> DataFrame:
    """(run, status, current_step, failed_step, completed) of each run that a batch has events of (update mode).

    ``events``: (run, seq, kind, step) as of ``plans.runs.run_state``, whose state this is once all have come. Events may come late or
    twice: the one with the largest seq decides, and a completed step stays completed. What is kept
    of a run are three events and its completed steps.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (None,) * 9 + ([],)
        last = {part: list(old[3 * k : 3 * k + 3]) for k, part in enumerate(_DECIDE)}
        completed = set(old[9])
        for batch in batches:
            for part, kinds in _DECIDE.items():
                mine = batch[batch["kind"].isin(kinds)]
                if len(mine):
                    top = mine.loc[mine["seq"].idxmax()]
                    if last[part][0] is None or top["seq"] > last[part][0]:
                        last[part] = [int(top["seq"]), top["kind"], None if pd.isna(top["step"]) else top["step"]]
            completed.update(batch.loc[batch["kind"] == "completed", "step"].dropna())
        done = sorted(completed)
        state.update((*(x for part in _DECIDE for x in last[part]), done))
        status = "completed" if last["status"][1] == "done" else last["status"][1] or "running"
        failed = last["failed"][2] if last["failed"][1] in ("failed", "interrupted") else None
        current = last["current"][2] if last["current"][1] == "running" else None
        yield pd.DataFrame({"run": [key[0]], "status": [status], "current_step": [current], "failed_step": [failed], "completed": [done]})

    out = f"run {events.schema['run'].dataType.simpleString()}, status string, current_step string, failed_step string, completed array<string>"
    rows = events.select("run", F.col("seq").cast("long").alias("seq"), "kind", "step")
    return rows.groupBy("run").applyInPandasWithState(step, out, _RUN_STATE, "update", GroupStateTimeout.NoTimeout)


def first_annotations(annotations: DataFrame) -> DataFrame:
    """(media_id, cue_no, annotation, term, known): each annotation whose term its medium has not had before, with
    how many terms it had by then (append mode).

    ``annotations``: (media_id, cue_no, annotation), batch by batch; within a batch the smaller number is first. An
    annotation without a term is left out. What is kept of a medium are its terms.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        terms = list(state.get[0]) if state.exists else []
        seen, out = set(terms), []
        for no, annotation, term in pd.concat(list(batches)).sort_values(["cue_no", "annotation"], kind="stable")[["cue_no", "annotation", "term"]].itertuples(index=False):
            if term not in seen:
                out.append((key[0], no, annotation, term, len(terms)))
                seen.add(term)
                terms.append(term)
        state.update((terms,))
        yield pd.DataFrame(out, columns=["media_id", "cue_no", "annotation", "term", "known"])

    media = annotations.schema["media_id"].dataType.simpleString()
    rows = annotations.select("media_id", F.col("cue_no").cast("long").alias("cue_no"), "annotation", T.annotation_term(F.col("annotation")).alias("term")).where("term <> ''")
    return rows.groupBy("media_id").applyInPandasWithState(step, f"media_id {media}, cue_no long, annotation string, term string, known long", "terms array<string>", "append", GroupStateTimeout.NoTimeout)
