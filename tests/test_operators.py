"""Small cases with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import images, jsonrepair, layout, matching, providers, scans, sequence
from folioflow.sources import books, store

AREA = "book string, page_idx long, area_pos long, type string, text string, ignored boolean, override boolean"


def areas(spark, rows):
    return spark.createDataFrame([("b", *r, *([False, None][len(r) - 4 :])) if len(r) < 6 else ("b", *r) for r in rows], AREA)


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_leaders_differ_by_use(spark):
    texts = ("12. Note", "12 Note", "¹² Note", "<sup>12</sup> Note", "* Note", "Note", None, "")
    assert one(spark, T.leading_consolidate, *texts) == [12, 12, 12, 12, None, None, None, None]
    assert one(spark, T.leading_renumber, *texts) == [None, 12, 12, 12, None, None, None, None]
    assert one(spark, T.leading_assemble, *texts) == ["12", "12", "12", "12", "*", None, None, None]


def test_hyphens_and_sups(spark):
    assert one(spark, T.repair_hyphens, "Babylo- nian", "пози- тивный", "a-b") == ["Babylonian", "позитивный", "a-b"]
    assert one(spark, T.revert_bad_sups, "<sup>1</sup>898", "<sup>1</sup><sup>8</sup>98", "x<sup>1</sup> 8") == ["1898", "1898", "x<sup>1</sup> 8"]
    assert one(spark, T.normalise_body, "a¹² b", "<sup>3-5</sup>", "<sup>5-3</sup>", "<sup>1-40</sup>") == ["a<sup>12</sup> b", "<sup>3</sup><sup>4</sup><sup>5</sup>", "<sup>5-3</sup>", "<sup>1-40</sup>"]


def test_review_entries_stay_inside_symbolic_ones(spark):
    assert one(spark, T.entries_review, "* See p.\n19 and 325.\n† Other", "1 a\n2 b", "") == [["* See p.\n19 and 325.", "† Other"], ["1 a", "2 b"], []]


def test_looks_cut(spark):
    assert one(spark, T.looks_cut, "He said", "He said.", 'He said."', "Done.<sup>2</sup>", "", None) == [True, False, False, False, False, False]


def test_running_notes(spark):
    a = areas(spark, [
        (0, 0, "main_text", "It was.<sup>1</sup> He.<sup>2</sup>"), (0, 1, "footnote", "1. First."), (0, 2, "footnote", "2. Second note runs-"),
        (1, 0, "main_text", "x<sup>3</sup>"), (1, 1, "footnote", "on to here."), (1, 2, "footnote", "3. Third."), (2, 0, "main_text", "no notes"), (3, 0, "footnote", "not a continuation"),
    ])
    got = {(r.page_idx, r.area_pos): (r.pieces, r.text) for r in sequence.consolidate(a).collect()}
    assert got == {(0, 1): (1, "1. First."), (0, 2): (2, "2. Second note runson to here."), (1, 2): (1, "3. Third."), (3, 0): (1, "not a continuation")}


def test_orphans(spark):
    a = areas(spark, [(0, 0, "main_text", 'a<sup>1</sup> He said."2 And'), (0, 1, "footnote", "1. One\n2. Two")])
    assert [r.n for r in sequence.orphan_markers(a).collect()] == [2]
    assert [r.new_text for r in sequence.wrap_orphans(a).collect()] == ['a<sup>1</sup> He said."<sup>2</sup> And']


def test_stitching(spark):
    rows = [(0, 0, "main_text", "And the uncom-"), (1, 0, "main_text", "mon thing.<sup>3</sup>"), (1, 1, "subtitle", "Next"), (2, 0, "main_text", "One\n\nTwo goes"), (3, 0, "main_text", "on.")]
    a = areas(spark, rows).withColumn("page_join", F.when(F.col("page_idx") == 0, "merge_hyphen"))
    got = [(r.kind, r.text) for r in sequence.stitch(a).orderBy("pos").collect()]
    assert got == [("paragraph", "And the uncommon thing.<sup>3</sup>"), ("subtitle", "Next"), ("paragraph", "One"), ("paragraph", "Two goes on.")]


def test_scans_like_one_window(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 3)
    rng = random.Random(1)
    rows = [(b, i, rng.choice([None, 1, 2, 5])) for b in "xy" for i in rng.sample(range(60), 25)]
    df = spark.createDataFrame(rows, "book string, i long, v long")
    out = scans.running_sum(df, "v", "s", ["book"], ["i"])
    out = scans.carry_forward(scans.carry_backward(scans.running_max_before(out, "v", "m", ["book"], ["i"]), "v", "nxt", ["book"], ["i"]), "v", "last", ["book"], ["i"])
    for r in out.collect():
        own = sorted((i, v) for b, i, v in rows if b == r.book)
        upto = [v for i, v in own if i <= r.i and v is not None]
        before = [v for i, v in own if i < r.i and v is not None]
        after = [v for i, v in own if i >= r.i and v is not None]
        assert (r.s or 0, r.m, r.last, r.nxt) == (sum(upto), max(before, default=None), upto[-1] if upto else None, after[0] if after else None)


def test_caption_moves(spark):
    rows = [("b", 0, 0, "illustration", None, False, "i0", None), ("b", 1, 0, "illustration_caption", "<<< Old map", False, None, None)]
    a = spark.createDataFrame(rows, "book string, page_idx long, area_pos long, type string, text string, ignored boolean, illustration_id string, linked_illustration_id string")
    assert [tuple(r) for r in matching.caption_moves(a).collect()] == [("b", 1, 0, 0, "i0", "Old map")]


WHOLE = '{"page_dimensions": {"width": 9, "height": 9}, "areas": [{"id": "a", "text": "x y"}, {"id": "b", "text": "z"}]}'


@pytest.mark.parametrize(("raw", "ids"), [(WHOLE, "ab"), (WHOLE.replace("x y", "x\ny"), "ab"), (WHOLE.replace("x y", 'said "no" then'), "ab"), (WHOLE[:-6], "a"), ("{", None), ("", None)])
def test_repair(raw, ids):
    got, how = jsonrepair.repair(raw)
    assert (None if got is None else "".join(x["id"] for x in got["areas"])) == ids, how


def test_repair_of_every_truncation():
    for n in range(len(WHOLE)):
        got, how = jsonrepair.repair(WHOLE[:n])
        assert got is None or isinstance(got, dict)
        assert n < 95 or got["areas"][0]["text"] == "x y", (n, how)


def test_clean(spark):
    raw = '```json\n{"id":"a","null,"type":"t","polygon":[[1,1],[9,1],[9,9],[1,9],"text":"v\\v"}\n```'.replace('[1,9],"text"', '[1,9],"text"')
    assert json.loads(one(spark, jsonrepair.clean, raw)[0])["type"] == "t"


def test_polygons(spark):
    rows = [(0, [[1, 2, 9, 8]]), (1, [[1, 2, 9, 2, 9, 8, 1, 8]]), (2, [[1, 2], [9, 8]]), (3, [[1, 2], [9, 2], [9, 8], [1, 8], [0, 0]]), (4, [[1, 1], [1, 1]]), (5, None)]
    got = {r.k: (r.verdict, r.polygon) for r in jsonrepair.check_areas(spark.createDataFrame(rows, "k int, polygon array<array<int>>"), ["k"]).collect()}
    box = [[1, 2], [9, 2], [9, 8], [1, 8]]
    assert [got[k] for k in range(6)] == [("ok", box)] * 3 + [("rejected", None), ("drop", None), ("rejected", None)]


def test_clip():
    assert layout.clip_polygon([[0, 0], [10, 0], [10, 10], [0, 10]], [(0, 8, 10, 20)]) == [[0, 0], [10, 0], [10, 4], [0, 4]]
    assert layout.clip_polygon([[0, 0], [10, 0], [10, 10], [0, 10]], [(20, 20, 30, 30)]) == [[0, 0], [10, 0], [10, 10], [0, 10]]


def test_image_kernels():
    np = pytest.importorskip("numpy")
    page = np.full((200, 150), 240, np.uint8)
    for y in range(20, 180, 12):
        page[y : y + 4, 15:135] = 20
    assert not images.inverted(page) and 20 <= images.otsu_level(np.bincount(page.ravel(), minlength=256)) < 240
    assert images.skew(page) is None and images.quarter_turn(page) is None and images.quarter_turn(np.rot90(page)) == 270
    left, top, right, bottom = images.content_box(page, padding=0)
    assert left <= 15 and top <= 20 and right >= 135 and bottom >= 176
    assert (images.rotate_image(images.rotate_image(page, 90), 270) == page).all()


def test_providers():
    calls = []

    def call(model, prompt):
        calls.append(model)
        if model == "a":
            raise ValueError("down")
        return prompt.upper()

    assert providers.first_that_works(["a", "b"], call, "x", attempts=2, wait=lambda s: None) == ("b", "X") and calls == ["a", "a", "b"]
    assert [providers.backoff(n) for n in (1, 6, 9)] == [2, 60, 60] and providers.is_rate_limit("HTTP 429")


def test_sources_and_upserts(spark, tmp_path):
    book = {"book": "S", "pages": [{"source_image": "page0001.png", "areas": [{"id": "a", "type": "main_text", "polygon": [[1, 2], [9, 2], [9, 8], [1, 8]], "text": "t"}, None]}, {"source_image": "page0002.png", "ignored": True}]}
    (tmp_path / "book.json").write_text(json.dumps(book))
    pages = books.pages_of(books.read_books(spark, str(tmp_path / "book.json")))
    assert pages.count() == 2
    assert [(r.id, r.x0, r.y1, r.override) for r in books.areas_of(pages).collect()] == [("a", 1, 8, None)]
    side = tmp_path / "pages"
    side.mkdir()
    (side / "page0001-areas.json").write_text(json.dumps({"source_image": "page0001.png", "rotation": 90, "detected_by": "m"}))
    new = books.read_sidecars(spark, str(side))
    old = new.withColumns({"rotation": F.lit(180), "detected_by": F.lit("old")})
    assert [(r.rotation, r.detected_by) for r in store.upsert_pages(old, new, ["source_image"]).collect()] == [(180, "m")]
    models = tmp_path / "models.cfg"
    models.write_text("# list\n[1] gemini:flash\n[2] other:x\n[prohibited] openrouter:y/z\n")
    assert [(r.tag, r.model) for r in books.read_models(spark, str(models)).orderBy("line").collect()] == [("1", "flash"), ("prohibited", "y/z")]


def test_stream(spark, tmp_path):
    from folioflow.streaming.ingest import sidecar_stream, upsert_stream

    side = tmp_path / "in"
    side.mkdir()
    for n, turn in ((1, 90), (2, 180)):
        (side / "page0001-areas.json").write_text(json.dumps({"source_image": "page0001.png", "rotation": turn}))
        (side / f"page000{n + 1}-areas.json").write_text(json.dumps({"source_image": f"page000{n + 1}.png", "detected_by": str(n)}))
        upsert_stream(sidecar_stream(spark, str(side)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.source_image: r.rotation for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"page0001.png": 90, "page0002.png": None, "page0003.png": None}


def test_epub(tmp_path):
    import zipfile

    store.write_epub(str(tmp_path / "b.epub"), "T & U", "A", '<div id="ch-1">One</div>', [("ch-1", "One")], images={"a.png": b"x"})
    with zipfile.ZipFile(tmp_path / "b.epub") as z:
        assert z.namelist()[0] == "mimetype" and "OEBPS/images/a.png" in z.namelist() and b"T &amp; U" in z.read("OEBPS/content.opf")


def test_gaps_are_filled_where_numbers_stand(spark):
    """Texts without a missing number at a fitting place never reach the replacement."""
    a = areas(spark, [(0, 0, "main_text", "a<sup>1</sup>"), (0, 1, "main_text", "x 2, y—3 (4) 05 5th 5 6 ٧ b7"), (0, 2, "main_text", "nothing here"), (0, 3, "main_text", "p 22 .2"), (0, 4, "main_text", "b<sup>9</sup>")])
    got = sequence.fill_gaps(a)
    assert "array_contains(there" in got._jdf.queryExecution().analyzed().toString()
    assert {r.area_pos: r.new_text for r in got.collect()} == {1: "x <sup>2</sup>, y—<sup>3</sup> (<sup>4</sup>) 05 5th <sup>5</sup> 6 ٧ b<sup>7</sup>", 3: "p 22 .<sup>2</sup>"}


def test_json_repair_in_slices(spark):
    """A batch is repaired slice by slice, not as one frame of Python strings."""
    assert list(jsonrepair._slices([])) == [] and list(jsonrepair._slices([5, 2 * jsonrepair.SLICE, 0, jsonrepair.SLICE, 1])) == [(0, 1), (1, 1), (2, 2), (4, 1)]
    rows = [(i, None if i == 7 else '{"a":"' + "x" * (300_000 if i % 50 == 0 else i) + ('"}' if i % 3 else "")) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, raw string")
    got = jsonrepair.repair_json(df)
    assert got.columns == ["k", "raw", "json", "how"] and "MapInArrow" in got._jdf.queryExecution().toString()
    found = {r.k: (r.raw, r.json, r.how) for r in got.collect()}
    assert found == {k: (raw, None, "failed") if raw is None else (raw, raw if k % 3 else raw + '"}', "plain" if k % 3 else "closed") for k, raw in rows}
    assert {r.k: r.json for r in jsonrepair.repair_json(df, keep=False).collect()} == {k: v[1] for k, v in found.items()}
