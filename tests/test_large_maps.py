"""Large prediction objects read in small byte ranges, against json.loads."""

import json
import random

import pytest

from calibrant.session import run_folder
from calibrant.sources import predictions
from calibrant.sources.large_maps import read_large_maps

NASTY = ['', 'plain', 'brace } in text', '{"a": [1}', 'quote \\" and \\\\', 'back\\slash}', '", "x": [{', '}}}', '\n}\n{',
         'é 日本 }', '[{]}', '\\']


def made(seed, variants, ids=False):
    draw, out = random.Random(seed), {}
    for name in variants:
        out[name] = [
            {"game_id": draw.choice(NASTY) + str(i), "prob": draw.choice([None, 0.5, 0.25]), "outcome": i % 2,
             "vegas": 0.5, "truncated": False} | ({"row_id": 1000 + i} if ids else {})
            for i in range(draw.randint(0, 60))]
    return out


def write(spark, texts):
    folder = run_folder(spark, "large")
    import os
    os.makedirs(folder)
    for i, text in enumerate(texts):
        with open(f"{folder}/{i}.json", "w") as out:
            out.write(text)
    return folder


def rows(df):
    return sorted((r["variant"], r["row_id"], r["game_id"], r["prob"], r["outcome"], r["market"]) for r in df.select(
        "variant", "row_id", "game_id", "prob", "outcome", "market").fillna({"prob": -1.0}).collect())


def wanted(maps):
    return sorted((name, r.get("row_id", i), r["game_id"], -1.0 if r["prob"] is None else r["prob"], r["outcome"], 0.5)
                  for held in maps for name, listed in held.items() for i, r in enumerate(listed))


@pytest.fixture(params=[97, 1 << 27])
def ranges(spark, request):
    """Byte ranges so small that records, texts and names are cut at every place."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in held.items():
        spark.conf.set(k, v)


def test_objects_of_any_layout(spark, ranges):
    for seed, indent in ((1, 2), (2, None)):
        held = made(seed, ["direct", 'na"me } x', "empty {", "日本"] if seed == 1 else ["a", "b"])
        folder = write(spark, [json.dumps(held, indent=indent, ensure_ascii=seed == 1)])
        assert rows(read_large_maps(spark, folder)) == wanted([held])


def test_a_bare_array(spark, ranges):
    held = made(3, ["_"])
    assert rows(read_large_maps(spark, write(spark, [json.dumps(held["_"], indent=1) + "\n"]))) == wanted([held])


def test_several_files(spark):
    one, two = made(4, ["a", "b"], ids=True), made(5, ["a", "c"], ids=True)
    folder = write(spark, [json.dumps(one, indent=2), json.dumps(two)])
    assert rows(predictions.read_prediction_maps(spark, folder, whole_file=True)) == wanted([one, two])
    clashing = write(spark, [json.dumps(made(6, ["a"])), json.dumps(made(7, ["a"]))])
    with pytest.raises(ValueError, match="several objects"):
        read_large_maps(spark, clashing)


def test_a_cut_file_is_an_error(spark):
    text = json.dumps(made(8, ["a", "b"]), indent=2)
    with pytest.raises(ValueError, match="not one whole object"):
        read_large_maps(spark, write(spark, [text[:len(text) // 2]]))


def test_a_large_file_is_read_by_many_tasks(spark):
    held = {"a": [{"game_id": f"g{i}", "prob": 0.5, "outcome": 1, "vegas": 0.5, "truncated": False} for i in range(20_000)]}
    folder = write(spark, [json.dumps(held, indent=4)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        df = read_large_maps(spark, folder)
        assert spark.read.option("lineSep", "}").text(folder).rdd.getNumPartitions() >= 8
        assert df.count() == 20_000 and df.agg({"row_id": "max"}).first()[0] == 19_999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
