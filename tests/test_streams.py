import os
import random
from datetime import datetime, timedelta

import pytest

from attestra.plans.streams import alr04_alert_lifecycle
from attestra.streaming.runner import collected, read_stream


def test_lifecycle_of_a_hot_user_in_many_batches(spark, tmp_path):
    rng = random.Random(2)
    user = lambda: 1 if rng.random() < 0.5 else rng.choice([*range(2, 40), None])
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(40000)), user(), rng.choice(["click", "view", "signup"]), rng.choice([None, rng.random() * 9])) for i in range(60000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for _, _, user, kind, value in sorted(rows, key=lambda r: (r[1], r[0])):
        status, level, moves = want.get(user, ("NONE", None, 0))
        jump = value is not None and level is not None and value > 1.5 * level
        after = "RESOLVED" if kind == "signup" else "ESCALATED" if jump else "ACTIVE" if status in ("NONE", "RESOLVED") else status
        want[user] = (after, value, moves + (after != status))
    assert {r.user_id: (r.status, r.moves) for r in alr04_alert_lifecycle(spark, str(tmp_path)).collect()} == {u: (s, m) for u, (s, _, m) in want.items()}


def test_update_mode_is_refused(spark, sf_dir):
    with pytest.raises(ValueError):
        collected(read_stream(spark, sf_dir, "events"), "update")


def test_alert_lifecycle_over_the_whole_table(spark, sf_dir):
    from attestra import catalog
    from attestra.plans.streams import _after

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value").collect()
    state = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.ts, r.event_id)):
        status, moves, level = state.get(r.user_id, ("NONE", 0, 0.0))
        value = float("nan") if r.value is None else r.value
        new = _after(status, r.event_type, value, level)
        state[r.user_id] = (new, moves + (new != status), value)
    got = {r.user_id: (r.status, r.moves) for r in catalog.queries()["alr04_alert_lifecycle"](spark, sf_dir).collect()}
    assert got == {u: v[:2] for u, v in state.items()} and len({v[0] for v in got.values()}) > 1


def test_clean_text_over_the_whole_table(spark, sf_dir):
    import re
    import unicodedata

    from attestra.functions.text import INVISIBLE, URL, clean
    from pyspark.sql import functions as F

    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", clean(F.col("text")).alias("got")).collect():
        if r.text is None:
            assert r.got is None
        else:
            want = re.sub(URL, "<URL>", re.sub(INVISIBLE, "", unicodedata.normalize("NFKC", r.text)), flags=re.A)
            assert r.got == re.sub(r"[ \t\n\x0b\f\r]+", " ", want).strip(" ")


def test_text_classifier_on_labels_it_has_not_seen(spark, sf_dir):
    from attestra import catalog
    from attestra.plans.intake import kept_back

    tables = os.path.join(os.path.dirname(sf_dir), "sf0.1")  # the smaller ones have too few labels to tell
    found = catalog.queries()["ml06_text_classifier"](spark, tables).withColumnRenamed("quality", "guess")
    rows = found.join(spark.read.parquet(f"{tables}/labels.parquet").where(kept_back()), "doc_id").collect()
    share = lambda v: sum(v) / len(v)
    assert len(rows) > 500 and share([r.guess == r.quality for r in rows]) > share([r.quality for r in rows]) + 0.05
    assert share([r.guess == 0 for r in rows if r.quality == 0]) > 0.45


def test_a_trigger_delivered_again_meets_its_events_once(spark, sf_dir):
    """Deliveries of one trigger do not multiply the candidates that are shuffled to its queue."""
    from attestra.plans.streams import triggered
    from attestra.streaming.runner import collected

    met = collected(triggered(spark, sf_dir)).select("trigger", "event_id")
    assert met.count() == met.distinct().count() > 0
