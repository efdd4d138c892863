"""Nearest points and names for questions against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from taktspur.functions.text import STOPWORDS
from taktspur.operators.joins import WEATHER_POINTS, with_nearest_point
from taktspur.operators.names import match_questions, names_with_words
from taktspur.operators.nearest import with_nearest


def plain_nearest(places, points):
    shrink = math.cos(math.radians(np.mean([p[1] for p in points])))
    lat = np.array([p[1] for p in points])[None, :] - places[:, 0][:, None]
    lon = (np.array([p[2] for p in points])[None, :] - places[:, 1][:, None]) * shrink
    return np.hypot(lat, lon).min(axis=1) * 111.0


def crowded(rng, n):
    """Towns of very different size, copies of one spot, and a few points far away."""
    parts = [rng.normal([47.4, 8.5], 1e-4, (n // 2, 2)), rng.normal([46.2, 6.1], 0.05, (n // 4, 2)),
             rng.uniform([45, 5], [48, 11], (n // 5, 2)), np.full((n // 20, 2), 46.5), [[-60.0, 170.0], [80.0, -170.0]]]
    return np.vstack(parts)


@pytest.mark.parametrize("leaf", [1, 4, 32, 10_000])
def test_nearest_of_a_crowded_table(spark, leaf):
    rng = np.random.default_rng(leaf)
    spots, asked = crowded(rng, 400), np.vstack([crowded(rng, 200), rng.uniform([-90, -180], [90, 180], (20, 2))])
    points = [(i, *map(float, p)) for i, p in enumerate(spots)]
    places = [(i, *map(float, p)) for i, p in enumerate(asked)] + [(9000, None, 8.0), (9001, float("nan"), 8.0)]
    got = with_nearest(spark.createDataFrame(places, "id long, lat double, lon double"),
                       spark.createDataFrame([*points, (77_777, None, 1.0), (None, 47.0, 8.0)], "key long, lat double, lon double"),
                       "key", leaf=leaf).toPandas().set_index("id")
    assert len(got) == len(places) and got.loc[[9000, 9001]].nearest.isna().all()
    known = got.loc[range(len(asked))]
    # The point without a key counts neither here nor there.
    assert np.allclose(known.distance_km, plain_nearest(asked, points), rtol=1e-12, atol=1e-9)
    spot = np.array([p[1:] for p in points])[known.nearest.astype(int)]
    shrink = math.cos(math.radians(np.mean(spots[:, 0])))
    away = np.hypot(spot[:, 0] - asked[:, 0], (spot[:, 1] - asked[:, 1]) * shrink) * 111.0
    assert np.allclose(away, known.distance_km, rtol=1e-9, atol=1e-9)


def test_nearest_of_one_of_none_and_of_equal_points(spark):
    places = spark.createDataFrame([(1, 46.0, 8.0), (2, 47.0, 9.0)], "id long, lat double, lon double")
    schema = "key string, lat double, lon double"
    assert {r.nearest for r in with_nearest(places, spark.createDataFrame([("a", 46.0, 8.0)], schema), "key").collect()} == {"a"}
    none = with_nearest(places, spark.createDataFrame([], schema), "key").collect()
    assert [(r.nearest, r.distance_km) for r in none] == [(None, None)] * 2
    same = spark.createDataFrame([("b", 46.5, 8.0), ("a", 46.5, 8.0), ("c", 45.5, 8.0)], schema)
    assert [r.nearest for r in with_nearest(places.where("id = 1"), same, "key").collect()] == ["a"]


def test_nearest_of_the_fixed_list_and_of_a_table_agree(spark):
    rng = random.Random(2)
    stations = spark.createDataFrame([(i, rng.uniform(45.8, 47.8), rng.uniform(6, 10.5)) for i in range(300)],
                                     "number long, lat double, lon double")
    points = spark.createDataFrame(WEATHER_POINTS, "abbr string, p_lat double, p_lon double")
    both = with_nearest(with_nearest_point(stations), points, "abbr", point_lat="p_lat", point_lon="p_lon", leaf=2).collect()
    assert all(r.nearest == r.nearest_weather_abbr for r in both)
    assert all(r.distance_km == pytest.approx(r.weather_distance_km) for r in both)


NAMES = ["Zürich HB", "Zürich Oerlikon", "Bern Wankdorf", "Bern", "Genève-Aéroport", "Oerlingen", "Aarau", "Olten"]


def test_names_of_many_questions(spark):
    rng = random.Random(6)
    pieces = [n[i:i + 4].lower() for n in NAMES for i in range(len(n) - 3)] + STOPWORDS + ["xyzx", "bern", "zürich", "oerl"]
    questions = [(i, " ".join(rng.choices(pieces, k=rng.randrange(6)))) for i in range(150)] + [(200, None), (201, ""), (202, "ab cd")]
    names = [(n, 10 * (i % 3), float(i)) for i, n in enumerate(NAMES)] + [(None, 99, 0.0)]

    def plain(text, k):
        import re
        words = [w for w in re.findall("[a-zäöü]{4,}", (text or "").lower()) if w not in STOPWORDS]
        hits = [(-n, name) for name, n, _ in names if name and any(w in name.lower() for w in words)]
        return [name for _, name in sorted(hits)[:k]]

    for k in (2, 8):
        got = match_questions(spark.createDataFrame(questions, "q long, question string"),
                              spark.createDataFrame(names, "haltestellen_name string, n long, mean_delay double"), ["q"], k=k).toPandas()
        for q, text in questions:
            assert got[got.q == q].sort_values("rank").haltestellen_name.tolist() == plain(text, k)


def test_words_are_found_anywhere_in_names(spark):
    asked = ["bern", "erli", "ich ", "e-a", "nowhere", "éro"]
    words = spark.createDataFrame([(w,) for w in asked], "w string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {(r.w, r["name"]) for r in names_with_words(words, names, "w", "name").collect()}
    assert got == {(w, n) for w in asked for n in NAMES if w in n.lower()}
    with pytest.raises(Exception, match="under three characters"):
        names_with_words(spark.createDataFrame([("hb",)], "w string"), names, "w", "name").collect()
