"""Calls of models in batches."""

from collections import Counter

from plotloom.operators import models


def test_batches_over_frames(spark):
    """A batch is one call, also where Arrow frames cut it; keys may be null, and tasks take many batches in one frame."""
    rows = [(k if k else None, i, f"{k}|{i}") for k in range(40) for i in range(k)] + [(2**60 + k, i, f"b{k}|{i}") for k in range(3) for i in range(9)]
    calls, frames = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(1)
        import inspect

        frames.add(int(inspect.stack()[1].frame.f_locals.get("low", 0) > 0))  # not the first batch of its frame
        if any(p.startswith("7|") for p in prompts):
            raise ValueError("seven")
        return [f"{prompts[0]} {len(prompts)}"] * len(prompts) if not prompts[0].startswith("5|") else ["too few"][: len(prompts) - 1]

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = models.in_batches(spark.createDataFrame(rows, "k long, i int, p string"), ["k"], "i")
        got = models.call_batches(df, ["k"], "i", "p", model).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    whole = {}
    for k, i, p in rows:
        whole.setdefault((k, i // 8), []).append(p)
    want = Counter()
    for k, i, p in rows:
        batch = whole[k, i // 8]
        error = "seven" if p.startswith("7|") else f"{min(1, len(batch) - 1)} answers to {len(batch)} prompts" if p.startswith("5|") else None
        want[k, i, p, None if error else f"{batch[0]} {len(batch)}", error] += 1
    assert Counter((r.k, r.i, r.p, r.response, r.error) for r in got) == want
    assert calls.value == len(whole) and frames.value > 0
