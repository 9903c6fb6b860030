"""What isn't linked with a pivot: unlike texts with a passage in common are not compared with each other."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from formline.llm import jaccard_join, minhash
from formline.llm.common import labels

PASSAGE = " ".join(f"common{i}" for i in range(30))


def _texts() -> list[tuple[int, str]]:
    unlike = [(i, f"{PASSAGE} " + " ".join(f"own{i}x{j}" for j in range(8))) for i in range(60)]
    twin = " ".join(f"twin{j}" for j in range(60))
    return [*unlike, (100, f"{PASSAGE} {twin}"), (101, f"{PASSAGE} {twin} more")]


@pytest.mark.parametrize(("module", "run"), [(jaccard_join, lambda d: jaccard_join.jaccard_groups(d, k=3, percent=90)), (minhash, lambda d: minhash.near_duplicates(d, k=4))])
def test_unlike_texts_with_a_common_passage_leave_no_differences(spark, monkeypatch, module, run):
    elements, plain = [], module.delta_links

    def seen(star, percent, groups):
        if groups is not None:
            elements.append(star.agg(F.sum(F.size("delta"))).first()[0] or 0)
        return plain(star, percent, groups)

    monkeypatch.setattr(module, "delta_links", seen)
    got = {r["doc_id"]: r["component_id"] for r in run(spark.createDataFrame(_texts(), "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(60)} | {100: 100, 101: 100}
    assert sum(elements) <= 200  # before: the differences of all texts to their pivots


def test_linked_members_of_two_components_meet(spark):
    base = list(range(100))
    sets = spark.createDataFrame([(1, base), (2, [*base[4:], 200, 201]), (3, [*base[:50], *range(300, 350)]), (4, list(range(400, 500)))], "mid long, set array<long>")
    members = sets.select("mid")
    none = spark.createDataFrame([], "mid long, component long")
    rows = minhash.crossing_tokens(members, sets, none, 90).collect()
    assert {r["mid"] for r in rows} == {1, 2}
    assert {r["tok"] for r in rows if r["mid"] == 1} & {r["tok"] for r in rows if r["mid"] == 2}
    known = labels(spark.createDataFrame([(1, 2)], "a long, b long"))
    assert minhash.crossing_tokens(members, sets, known, 90).count() == 0
