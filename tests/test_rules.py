"""Rules against cases worked out by hand."""

import json

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import assemble, chapters, edits, layout, linking, matching, polish, reports, sequence
from folioflow.sources import books

AREA = "book string, page_idx long, area_pos long, type string, text string, ignored boolean, override boolean, consolidated boolean"


def areas(spark, rows):
    return spark.createDataFrame([("b", *r, *([False, None, False][len(r) - 4 :])) for r in rows], AREA)


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_texts(spark):
    assert one(spark, T.repair_hyphens, "Babylo- nian", "ver-„lust", "ver-,, lust", "a-b") == ["Babylonian", "verlust", "verlust", "a-b"]
    assert one(spark, T.space_before_marks, "a ,b  ;c", "\t,x", " ,y") == ["a,b;c", "\t,x", " ,y"]
    assert one(spark, T.revert_bad_sups, "".join(f"<sup>{k % 10}</sup>" for k in range(12)) + "5") == ["0123456789015"]
    assert one(spark, T.looks_cut, "so <i>x <b>y</b></i>", "end.<sup>5</sup>", "end.’”", "end.}", "word</i>", "a <sup>1</sup><sup>2</sup>", "Stop!<i><b>z</b></i>") == [True, False, False, False, True, True, False]
    assert one(spark, T.is_lone_number, "VI.", "vi", "1234", "12 a", " 7 ") == [True, False, True, False, True]
    assert one(spark, T.is_all_caps, "ЗАМѢЧАНІЯ 5", "12", "Abc", "...") == [True, True, False, False]
    assert one(spark, T.is_notes_title, "Notes *", "footnotes", "Notes on Sources.", "Anmerkungen") == [True, False, True, False]


def test_renumbering_keeps_forms(spark):
    a = areas(spark, [
        (0, 0, "main_text", "a<sup>1</sup> b² c³ d<sup>7a</sup>"), (0, 1, "footnote", "1 One\n² Two 2\n<sup>3</sup> Three\n107a alpha\n9. point"),
        (1, 0, "main_text", "x<sup>1</sup>"), (1, 1, "footnote", "  1 Again 1"),
    ])
    assert {(r.page_idx, r.old): r.new for r in sequence.renumbering(a).collect()} == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (1, 1): 4}
    got = {(r.page_idx, r.area_pos): r.new_text for r in sequence.renumber(a, start=5).collect()}
    assert got == {
        (0, 0): "a<sup>5</sup> b⁶ c⁷ d<sup>7a</sup>", (0, 1): "5 One\n⁶ Two 2\n<sup>7</sup> Three\n107a alpha\n9. point",
        (1, 0): "x<sup>8</sup>", (1, 1): "  8 Again 1",
    }


def test_gaps_and_order(spark):
    a = areas(spark, [(0, 0, "footnote", "2. b"), (1, 0, "main_text", "-"), (2, 0, "footnote", "5 e"), (2, 1, "footnote", "4. gone", False, None, True)])
    assert [tuple(r) for r in sequence.sequence_gaps(a).orderBy("first_missing").collect()] == [("b", 0, 1, 1, 0, 2)[:4] + (0, 0), ("b", 0, 3, 4, 0, 2)]
    rows = [(0, 0, "footnote", "1. a"), (1, 0, "footnote", "24. x"), (1, 1, "footnote", "27. y"), (2, 0, "footnote", "23. late"), (3, 0, "main_text", "-"), (4, 0, "footnote", "1. new")]
    got = sequence.out_of_order(areas(spark, rows)).collect()
    assert [(r.page_idx, r.chapter, r.n, r.seen, r.before_page) for r in got] == [(2, 1, 23, 27, 3)]
    wild = areas(spark, [(0, 0, "footnote", "1. a"), (0, 1, "footnote", "999999999999 b"), (0, 2, "main_text", "<sup>99999999999999999999</sup> <sup>1</sup> <sup>4</sup>")])
    assert [(r.first_missing, r.last_missing) for r in sequence.sequence_gaps(wild).collect()] == [(2, 999999999998)]
    assert [(r.n_missing, r.missing) for r in sequence.internal_gaps(wild).collect()] == [(2, "2-3")]


def test_gap_fill(spark):
    rows = [(0, 0, "main_text", "a<sup>60</sup> b"), (1, 0, "main_text", "Ltua Gulf 62 and 1962, x61 y"), (2, 0, "chapter_title", "T"), (3, 0, "main_text", "z<sup>63</sup> 61")]
    got = {r.page_idx: r.new_text for r in sequence.fill_gaps(areas(spark, rows)).collect()}
    assert got == {1: "Ltua Gulf <sup>62</sup> and 1962, x<sup>61</sup> y"}
    inside = areas(spark, [(0, 0, "main_text", "a<sup>1</sup> b 2 c<sup>3</sup>"), (1, 0, "main_text", "c<sup>40</sup>")])
    assert {r.new_text for r in sequence.fill_gaps(inside).collect()} == {"a<sup>1</sup> b <sup>2</sup> c<sup>3</sup>"}


def test_regime(spark):
    page = lambda i, kind, text, off=False: (i, 0, kind, text, off)
    body = [page(i, "main_text", "x") for i in range(1, 9)]
    kind = lambda rows: reports.detect_regime(areas(spark, rows)).first().regime
    assert kind([*body, page(9, "chapter_title", "Notes")]) == "endnotes"
    assert kind([*body, page(9, "subtitle", "Notes")]) == "per_page"
    assert kind([*body, page(9, "chapter_title", "Footnotes")]) == "per_page"
    assert kind([*body, page(9, "chapter_title", "Notes", True)]) == "per_page"
    assert kind([*body, page(9, "chapter_title", "Notes"), (3, 1, "footnote", "1. a")]) == "mixed"
    assert kind([*body, page(9, "chapter_title", "Notes"), (3, 1, "footnote", "1. a", False, None, True)]) == "endnotes"
    assert kind([page(0, "chapter_title", "notes"), *body, page(9, "chapter_title", "Notes")]) == "inline_endnotes"


def test_reading_order(spark):
    box = "book string, page_idx long, area_pos long, type string, x0 long, y0 long, x1 long, y1 long"
    rows = [("b", 0, 0, "chapter_title", 600, 10, 900, 40), ("b", 0, 1, "illustration", 50, 100, 300, 400), ("b", 0, 2, "main_text", 200, 120, 990, 300)]
    got = {r.area_pos: r.reading_pos for r in layout.reading_order(spark.createDataFrame(rows, box)).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [1, 0, 2]  # no narrow main text: nothing stands above
    rows = [("b", 0, 0, "main_text", 520, 200, 950, 900), ("b", 0, 1, "main_text", 50, 210, 480, 900), ("b", 0, 2, "chapter_title", 100, 20, 900, 60)]
    got = {r.area_pos: r.reading_pos for r in layout.reading_order(spark.createDataFrame(rows, box)).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [2, 1, 0]
    turned = spark.createDataFrame([("b", 0, 0, "main_text", 10, 600, 90, 900, 100, 1000, 90), ("b", 0, 1, "main_text", 10, 100, 90, 400, 100, 1000, 90)], box + ", page_w int, page_h int, rotation int")
    assert layout.two_columns(turned).first().two_columns


def test_captions_by_contents(spark):
    rows = [("b", 0, 0, "illustration", None, False, "", None), ("b", 0, 1, "illustration", None, False, "i1", None), ("b", 1, 0, "illustration_caption", "Map <<< of >>> Rome", False, None, None), ("b", 1, 1, "illustration_caption", "<<<", False, None, None)]
    a = spark.createDataFrame(rows, "book string, page_idx long, area_pos long, type string, text string, ignored boolean, illustration_id string, linked_illustration_id string")
    got = {r.area_pos: (r.to_page, r.to_illustration, r.caption) for r in matching.caption_moves(a).collect()}
    assert got == {0: (0, "i1", "Map  of >>> Rome"), 1: (None, None, None)}


def test_titles(spark):
    rows = [(0, 0, "chapter_title", "VI"), (0, 1, "footnote", "1. no element"), (0, 2, "chapter_title", "Приливы"), (1, 0, "chapter_title", "I."), (1, 1, "chapter_title", "II"), (1, 2, "chapter_title", "Three"), (1, 3, "chapter_title", "7"), (1, 4, "main_text", "x"), (1, 5, "chapter_title", "Eight")]
    a = areas(spark, rows).withColumn("illustration_id", F.lit(None).cast("string"))
    got = [(r.text, r.merged) for r in assemble.merge_split_titles(a).orderBy("page_idx", "area_pos").collect()]
    assert got == [("VI. Приливы", True), ("I. II", True), ("Three", False), ("7", False), ("Eight", False)]
    rows = [(0, 0, "chapter_title", "Отдѣленіе второе."), (0, 1, "main_text", "ЗАМѢЧАНІЯ ОБЪ\nОСТРОВАХЪ.\n\nmore"), (1, 0, "chapter_title", "One"), (1, 1, "main_text", "1812")]
    a = areas(spark, rows).withColumn("illustration_id", F.lit(None).cast("string"))
    assert [r.text for r in assemble.absorb_all_caps(a).orderBy("page_idx").collect()] == ["Отдѣленіе второе. ЗАМѢЧАНІЯ ОБЪ ОСТРОВАХЪ.", "One. 1812"]


def test_text_export(spark):
    rows = [("b", 0, "book", "T"), ("b", 1, "chapter_title", "C"), ("b", 2, "paragraph", "one \n two<sup>3</sup><sup> </sup> x  y"), ("b", 3, "figure", ""), ("b", 4, "figure", "Map"), ("b", 5, "quote", "no"), ("b", 9, "note", '3. n\nm<a href="#s" class="backlink">↩</a>')]
    got = assemble.to_txt(spark.createDataFrame(rows, "book string, pos long, kind string, text string")).first().text
    assert got == "# T\n\n## C\n\none two[3] x y\n\n[Illustration]\n\n[Illustration: Map]\n\n---\n\n## Footnotes\n\n3. n m\n"


def test_endnotes_start(spark):
    rows = [(i, 0, "main_text", "plain") for i in range(9)] + [(5, 1, "chapter_title", "Sources and Notes"), (7, 1, "main_text", "text\n 12. Ibid."), (1, 1, "chapter_title", "Notes"), (2, 1, "main_text", "3. x")]
    assert matching.endnotes_start(areas(spark, rows)).first().start == 5  # page 1 lies in the first third
    rows = [(i, 0, "main_text", "plain") for i in range(9)] + [(4, 1, "chapter_title", "Apparatus"), (6, 1, "subtitle", "1. Rome"), (6, 2, "main_text", "1. a")]
    assert matching.endnotes_start(areas(spark, rows)).first().start == 4
    assert matching.endnotes_start(areas(spark, rows[:-1])).first().start is None


BOOK = [
    (0, 0, "chapter_title", "1. Rome"), (0, 1, "main_text", "a<sup>1</sup> b<sup>2</sup>"), (1, 0, "main_text", "c<sup>4</sup>"),
    (2, 0, "chapter_title", "Epilogue"), (2, 1, "main_text", "d<sup>1</sup>"), (3, 0, "chapter_title", "Notes"),
    (4, 0, "subtitle", "Chapter 1"), (4, 1, "main_text", "1. x\n2. y\n3 z"), (4, 2, "main_text", "Epilogue\n1. w"), (5, 0, "chapter_title", "Chapter 9"), (5, 1, "main_text", "5. v"),
]


def test_chapter_review(spark):
    a, start = areas(spark, BOOK), spark.createDataFrame([("b", 3)], "book string, start long")
    got = {r.n if r.n is not None else r.title: r for r in chapters.chapter_review(a, start).collect()}
    row = lambda k: (got[k].name_match, got[k].missing_entries, got[k].missing_sups, got[k].state, got[k].badge, got[k].place)
    assert set(got) == {1, 9, "epilogue"}
    assert row(1) == ("chapter_num_only", "4", "3", "red", "3↑·3fn", 1)
    assert row("epilogue") == ("exact", "", "", "green", "1↑·1fn", 2)
    assert row(9) == ("notes_only", "", "5", "red", "0↑·1fn", 3)
    gaps = [tuple(r)[2:] for r in chapters.chapter_sup_gaps(a, start).collect()]
    assert gaps == [(3, 3, 0, None)]
    total = chapters.review_totals(chapters.chapter_review(a, start)).first()
    assert (total.chapters, total.red, total.names) == (3, 2, 1)


def test_inline_review(spark):
    rows = [
        (0, 0, "chapter_title", "First"), (0, 1, "main_text", "a<sup>1</sup>"), (1, 0, "chapter_title", "Second"), (1, 1, "main_text", "b<sup>2</sup> c<sup>4</sup>"),
        (2, 0, "chapter_title", "Notes"), (2, 1, "footnote", "1. x\n2. y\n5. z"), (2, 2, "main_text", "late<sup>4</sup>"), (3, 0, "chapter_title", "Third"), (3, 1, "main_text", "d<sup>1</sup>"), (3, 2, "footnote", "1. w"),
    ]
    got = {r.section: (r.owner, r.missing_entries, r.missing_sups, r.state) for r in chapters.inline_review(areas(spark, rows)).collect()}
    assert got == {1: (2, "", "", "green"), 2: (2, "4", "5", "red"), 3: (3, "", "", "green")}
    tiles = [(r.page_idx, r.kind, r.zone, r.numbers, r.state, r.badge) for r in chapters.page_tiles(areas(spark, rows)).orderBy("page_idx", "order").collect()]
    assert tiles == [
        (0, "", "body", "1", "green", "1↑ [1]"), (1, "", "body", "2,4", "red", "2↑ [2–4]"), (2, ":body", "body", "4", "green", "1↑ [4]"),
        (2, "", "endnote", "1,2,5", None, "1–5"), (3, "", "body", "1", "green", "1↑ [1]"), (3, ":en", "endnote", "1", None, "1"),
    ]


def test_polishing(spark):
    rows = [(0, 0, "main_text", "Babylo- nian text 12 more text"), (0, 1, "footnote", "12. Note"), (0, 2, "main_text", "the uncom-"), (1, 0, "main_text", "mon thing"), (2, 0, "main_text", "off", True)]
    a = areas(spark, rows)
    sent = polish.requests(a)
    items = {r.page_idx: json.loads(r.items) for r in sent.collect()}
    assert items == {0: [{"id": 0, "type": "main_text", "text": "Babylonian text 12 more text"}, {"id": 1, "type": "footnote", "text": "12. Note"}, {"id": 2, "type": "main_text", "text": "the uncom-", "is_last_main": True, "next_page_prefix": "mon thing"}], 1: [{"id": 0, "type": "main_text", "text": "mon thing", "is_last_main": True}]}
    raw = '```json\n[{"id":0,"fixes":[{"type":"footnote","find":"text 12 more","replace":"text <sup>1</sup>2 \\v more"},{"type":"x","find":"none","replace":"y"}]},{"id":2,"fixes":[{"type":"ocr_hyphen","part1":"uncom","part2":"mon"}]},{"id":7}]\n```'
    answers = spark.createDataFrame([("b", 0, raw), ("b", 1, "sorry")], "book string, page_idx long, raw string")
    changed, pages = polish.apply_answers(a, sent, answers)
    assert {(r.page_idx, r.area_pos): r.new_text for r in changed.collect()} == {(0, 0): "Babylonian text 12 v more text", (0, 2): "the uncom-"}
    assert [(r.page_idx, r.page_join, r.polished) for r in pages.collect()] == [(0, "merge_hyphen", True)]
    fix = lambda t, *f: spark.createDataFrame([(t, list(f))], f"t string, f array<{polish.FIX}>").select(polish.apply_fixes(F.col("t"), F.col("f"))).first()[0]
    assert fix("a $x- \n y, $x- y", ("ocr_hyphen", "$x", "y", None, None)) == "a $xy, $x- y"
    assert fix("aa aa", ("o", None, None, "aa", "b\\1")) == "b\\1 aa"


def test_linking(spark):
    kinds = "book string, pos long, kind string, text string"
    rows = [
        ("b", 0, "paragraph", "a<sup>*</sup> b<sup>1</sup> c<sup>*</sup>"), ("b", 1, "chapter_title", "1. Rome"), ("b", 2, "paragraph", "d<sup>1</sup> e<sup>2</sup> f<sup>1</sup>"),
        ("b", 3, "chapter_title", "Notes"), ("b", 4, "subtitle", "Chapter 1"), ("b", 5, "paragraph", "1. Entry one, p. 5."), ("b", 6, "paragraph", "see<sup>2</sup>"),
        ("b", 10, "note", "* star"), ("b", 11, "note", "1. first"), ("b", 12, "note", "2 second"),
    ]
    e = spark.createDataFrame(rows, kinds)
    got = [(r.pos, r.marker, r.way, r.item_pos, r.number) for r in linking.link(e).orderBy("pos", "k").collect()]
    assert got == [(0, "*", "symbol", 10, 1), (0, "1", "paged", 11, 2), (0, "*", None, None, None), (2, "1", "chapter", 5, 3), (2, "2", "paged", 12, 4), (2, "1", "chapter", 5, 5)]
    items = {r.pos: (r.id, r.text) for r in linking.linked_items(e, linking.link(e)).collect()}
    assert items[10] == ("fn-1", '1. star<a href="#sup-fn-1" class="backlink">↩</a>') and items[5][0] == "fn-3" and items[5][1].count("↩") == 2 and items[12][1].startswith("4. second")
    two = [("b", 0, "paragraph", "<sup>1</sup>"), ("b", 1, "chapter_title", "Notes"), ("b", 2, "paragraph", "<sup>1</sup>"), ("b", 3, "chapter_title", "NOTES."), ("b", 9, "note", "1. a"), ("b", 10, "note", "1. b")]
    assert [r.item_pos for r in linking.link(spark.createDataFrame(two, kinds)).orderBy("pos").collect()] == [9, 9]  # the count begins anew at each Notes title
    packed = one(spark, linking.note_items, "¹ first\n² second\n³ third", "¹ first<sup>2</sup>second<sup>3</sup>third", "plain <sup>2</sup>")
    assert packed == [["¹ first", "² second", "³ third"], ["¹ first", "<sup>2</sup>second", "<sup>3</sup>third"], ["plain <sup>2</sup>"]]
    assert one(spark, linking.unwrap_nested_sups, "<sup><sup><sup>1</sup></sup></sup> <sup>2</sup>") == ["<sup>1</sup> <sup>2</sup>"]
    assert one(spark, linking.misclassified_header, "5. Rome", "11. Imperial enterprises", "5. Rome 2", "107. Rome") == [True, True, False, False]


def test_edits(spark):
    a = areas(spark, [(0, 0, "footnote", "2. Second runs-"), (1, 0, "main_text", "x"), (1, 1, "footnote", "on to here."), (2, 0, "main_text", "no notes"), (3, 0, "footnote", "alone")])
    done = {(r.page_idx, r.area_pos): (r.text, r.consolidated) for r in edits.consolidate_area(a, "b", 1, 1).collect()}
    assert done == {(0, 0): ("2. Second runson to here.", False), (1, 1): ("on to here.", True)}
    assert edits.consolidate_area(a, "b", 3, 0).count() == 0
    b = areas(spark, [(0, 0, "footnote", "2. Second runson to here."), (1, 1, "footnote", "on to here.", False, None, True)])
    back = {(r.page_idx, r.area_pos): (r.text, r.override) for r in edits.deconsolidate_area(b, "b", 1, 1).collect()}
    assert back == {(0, 0): ("2. Second runs-", None), (1, 1): ("on to here.", False)}
    p = spark.createDataFrame([("p1", "T", "A", "1956", "“/x/Café.pdf”"), ("p2", "U", "", "", "/y/dir/")], "id string, title string, author string, year string, source_path string")
    got = {r.book: r.id for r in edits.project_of(spark.createDataFrame([("Café", "/z"), ("other", "/y/dir"), ("none", "/n")], "book string, folder string"), p).collect()}
    assert got == {"Café": "p1", "other": "p2"}


def test_book_from_file_to_text(spark, tmp_path):
    """A book JSON read, its notes consolidated, renumbered, reviewed, its body stitched and exported."""
    area = lambda i, kind, y, text: {"id": f"area_{i:03d}", "type": kind, "polygon": [[80, y], [920, y], [920, y + 50], [80, y + 50]], "text": text}
    book = {"book": "Sample", "footnote_regime": "per_page", "pages": [
        {"source_image": "page0001.png", "page_dimensions": {"width": 1000, "height": 1600}, "page_join": "merge_hyphen", "polished": True, "areas": [area(1, "chapter_title", 80, "1. Rome"), area(2, "main_text", 200, 'It was so.<sup>1</sup> He said."2 And the uncom-'), area(3, "footnote", 1300, "1. First note.\n2. Second note runs-"), None]},
        {"source_image": "page0002.png", "page_dimensions": {"width": 1000, "height": 1600}, "page_join": "new_paragraph", "areas": [area(1, "main_text", 100, "mon thing.<sup>3</sup>"), area(3, "footnote", 1300, "on to here."), area(4, "footnote", 1360, "3. Third.")]},
        {"source_image": "page0003.png", "ignored": True, "areas": []}, {"source_image": "page0004.png", "process_later": True},
    ]}
    (tmp_path / "Sample.json").write_text(json.dumps(book))
    pages = books.pages_of(books.read_books(spark, str(tmp_path / "Sample.json"))).cache()
    a = books.areas_of(pages)
    assert a.count() == 6
    assert [r.new_text for r in sequence.wrap_orphans(a).collect()] == ['It was so.<sup>1</sup> He said."<sup>2</sup> And the uncom-']
    notes = {(r.page_idx, r.area_pos): r.text for r in sequence.consolidate(a).collect()}
    assert notes == {(0, 2): "1. First note.\n2. Second note runson to here.", (1, 2): "3. Third."}
    txt = assemble.to_txt(sequence.stitch(a)).first().text
    assert txt == '## 1. Rome\n\nIt was so.[1] He said."2 And the uncommon thing.[3]\n'
    state = reports.project_state(pages, a).first()
    assert (state.area_pages, state.ignored_pages, state.pending_area_pages, state.process_later_pending, state.total_areas, state.polished_pages, state.polished_count) == (2, 1, 1, 1, 6, 2, 2)
    assert (state.fn_review_relevant, state.fn_review_mismatched) == (2, 2)
    assert [r.source_image for r in reports.pending_pages(pages).collect()] == ["page0004.png"]
    assert {r.page_idx: (r.sup_count, r.fn_count, r.state, r.badge) for r in reports.footnote_review(a).collect()} == {0: (1, 2, "red", "1↑·2fn"), 1: (1, 2, "red", "1↑·2fn")}


def test_pages_and_files(spark, tmp_path):
    files = spark.createDataFrame([("/x/b.PNG",), ("/x/.c.png",), ("/x/a.jpg",), ("/x/n.txt",)], "path string")
    assert [(r.name, r.stem) for r in books.number_images(files).orderBy("page").collect()] == [("a.jpg", "page0001"), ("b.PNG", "page0002")]
    for n in ("book.json", "One.json"):
        (tmp_path / n).write_text("{}")
    assert books.find_book(spark, str(tmp_path)).endswith("/One.json") and books.find_book(spark, str(tmp_path), "book").endswith("/book.json")
    from folioflow.operators import expand
    from folioflow.sources import store

    p = spark.createDataFrame([(1, "page0001.png"), (2, "cover.png")], "page_idx long, source_image string")
    assert [r.page_idx for r in expand.select_named(p, "cover").collect()] == [2] and [r.page_idx for r in expand.select_named(p, "1-1").collect()] == [1]
    path = store.backup(spark, str(tmp_path / "One.json"))
    assert open(path).read() == "{}"
    store.dump(spark.createDataFrame([("b", "page0001", "raw\ntext")], "book string, name string, text string"), str(tmp_path / "dump"))
    assert json.loads(spark.read.text(str(tmp_path / "dump")).first().value) == {"name": "page0001", "text": "raw\ntext"}


def test_elements(spark):
    kind = "book string, page_idx long, area_pos long, type string, polygon array<array<int>>, source_image string, illustration_id string, ignored boolean, page_w int, page_h int"
    tri = [[0, 0], [9, 0], [9, 9]]
    a = spark.createDataFrame([("b", 0, 0, "illustration", tri, "page0001.png", "x", False, 10, 20), ("b", 0, 1, "illustration", tri, "page0001.png", None, False, 10, 20), ("b", 0, 2, "illustration", [[1, 1]], "page0001.png", None, False, 10, 20)], kind)
    assert [r.file for r in assemble.illustration_ids(a).orderBy("area_pos").collect()] == ["page0001_x.png", "page0001_illus_002.png"]
    assert assemble.overlay(a.limit(1)).first().svg == '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 10 20"><polygon class="illustration" points="0,0 9,0 9,9"/></svg>'
    e = spark.createDataFrame([("b", 0, '<figure><img src="elements/p_i.png"></figure>'), ("b", 1, "<p>x</p>"), ("b", 2, '<figure><img src="elements/p_i.png"></figure>'), ("b", 3, "<p>x</p>")], "book string, pos long, html string")
    assert [r.html for r in assemble.epub_body(e).orderBy("pos").collect()] == ['<figure><img src="images/p_i.jpg"></figure>', "<p>x</p>", "<p>x</p>"]
    assert one(spark, lambda c: assemble.rewrite_sources(c, "elements", "/p/1"), '<img src="elements/a.png">') == ['<img src="/p/1/a.png">']
    r = assemble.compression_report(spark.createDataFrame([("b", 100, 30), ("b", 100, 50)], "book string, before long, after long")).first()
    assert (r.files, r.saved_pct) == (2, 60.0)


def test_geometry(spark):
    box = spark.range(1).select(layout.crop_box(F.expr("array(array(10, 10), array(90, 10), array(90, 60), array(10, 60))"), F.lit(0.0), F.lit(100), F.lit(100)).alias("a"), layout.crop_box(F.expr("array(array(10, 10), array(90, 10), array(90, 60), array(10, 60))"), F.lit(90.0), F.lit(100), F.lit(100)).alias("b"), layout.rotated_content_box(F.expr("struct(1 AS left, 2 AS top, 3 AS right, 4 AS bottom)"), F.lit(90), F.lit(10), F.lit(20)).alias("c"), layout.content_box(F.expr("struct(1 AS left, cast(null AS int) AS top, 3 AS right, 4 AS bottom)")).alias("d"), layout.page_point(F.lit(500), F.lit(1000), F.lit(801), F.lit(40)).alias("e")).first()
    assert tuple(box.a) == (10, 10, 90, 60) and tuple(box.b) == (10, 10, 60, 60) and tuple(box.c) == (16, 1, 18, 3) and box.d is None and box.e == 440


def test_images():
    import numpy as np

    from folioflow.operators import images

    page = np.full((300, 200), 240, np.uint8)
    for y in range(20, 200, 12):
        page[y : y + 4, 20:180] = 10
    assert images.quarter_turn(page) is None and images.quarter_turn(np.rot90(page)) == 270
    assert images.snap_outward(page < 100, (30, 40, 100, 60)) == (19, 40, 140, 61)
    small = images.for_model(page, None, 150)
    assert small.shape == (150, 100) and abs(float(small.mean()) - float(page.mean())) < 1


def test_clusters(spark):
    from folioflow.operators import images

    d = spark.createDataFrame([("p", y, n) for y, n in ((0, 5), (200, 5), (700, 20), (1200, 1))], "page string, y long, n long")
    assert [tuple(r) for r in images.largest_cluster(d, ["page"]).collect()] == [("p", 700, 700, 20)]


def test_clips_take_pages_together(spark):
    import random

    draw, rows = random.Random(5), []
    for page in range(60):
        for k in range(12):
            x, y = draw.randrange(0, 600, 20), draw.randrange(0, 600, 20)
            rows.append(("b", page, k, draw.choice(["illustration", "main_text", "footnote", "table"]), x, y, x + draw.randrange(40, 400, 20), y + draw.randrange(40, 400, 20)))
    df = spark.createDataFrame(rows, "book string, page_idx long, area_pos long, type string, x0 long, y0 long, x1 long, y1 long").repartition(5)
    got = layout.clip_illustrations(df)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    want = {}
    for _, page, k, kind, x0, y0, x1, y1 in rows:
        if kind == "illustration":
            want[page, k] = layout.clip_polygon([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], [r[4:] for r in rows if r[1] == page and r[3] in layout.ILLUSTRATION_TEXT])
    assert {(r.page_idx, r.area_pos): r.polygon for r in got.collect()} == want
    assert any(not p for p in want.values()) and any(len(p) == 4 for p in want.values())


def _scanned(monkeypatch) -> list:
    """What block-wise scans write down from now on."""
    from folioflow.operators import scans

    seen, cut = [], scans.cut
    monkeypatch.setattr(scans, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    return seen


def _written(tables) -> int:
    return sum(t.select(F.max(F.length(F.to_json(F.struct(*t.columns))))).first()[0] or 0 for t in tables)


def test_title_scans_carry_no_texts(spark, monkeypatch):
    seen = _scanned(monkeypatch)
    long = "word " * 20000
    rows = [(0, 0, "chapter_title", "VI"), (0, 1, "chapter_title", "One"), (0, 2, "main_text", long), (1, 0, "chapter_title", "7"), (1, 1, "main_text", "LOUD"), (1, 2, "chapter_title", "I"), (2, 0, "chapter_title", "II")]
    a = areas(spark, rows).withColumn("illustration_id", F.lit(None).cast("string"))
    assert [r.text for r in assemble.merge_split_titles(a).orderBy("page_idx", "area_pos").collect()] == ["VI. One", "7", "I. II"]
    assert [r.text for r in assemble.absorb_all_caps(a).orderBy("page_idx", "area_pos").collect()] == ["VI", "One", "7. LOUD", "I", "II"]
    assert len(seen) > 1 and _written(seen) < 5000


def test_stitching_by_blocks(spark, monkeypatch):
    import random

    from folioflow.operators import scans

    draw, rows, hows = random.Random(7), [], {}
    kinds = ["main_text"] * 12 + ["footnote"] * 4 + ["subtitle", "quote", "illustration"]
    for page in range(120):
        hows[page] = draw.choice(["merge_hyphen", "merge_sentence", "new_paragraph", None])
        for k in range(draw.randrange(1, 4)):
            kind = "main_text" if 40 <= page < 70 and draw.random() < 0.9 else draw.choice(kinds)  # some blocks have nothing that closes a paragraph
            rows.append((page, k, "footnote" if 40 <= page < 70 and kind in ("subtitle", "quote", "illustration") else kind, draw.choice(["so-", "it goes on", "end.", "a\n\nb", "x\n1. y", "", None]), page % 11 == 5))
    fold = sequence._Fold()
    for page, _, kind, text, off in rows:
        if not off:
            fold.area(page, kind, (text or "").strip(), hows[page])
    fold.flush()
    want = list(enumerate(fold.take()))
    a = areas(spark, rows).repartition(7).join(spark.createDataFrame(list(hows.items()), "page_idx long, page_join string"), "page_idx")
    for block in (3, 1000):
        monkeypatch.setattr(scans, "BLOCK", block)
        got = sequence.stitch(a)
        assert sorted((r.pos, (r.kind, r.text)) for r in got.collect()) == want, block
    two = sequence.stitch(a.unionByName(a.withColumn("book", F.lit("c"))))
    assert two.filter("book = 'b'").count() == two.filter("book = 'c'").count() == len(want)


def test_link_scans_carry_no_texts(spark, monkeypatch):
    seen = _scanned(monkeypatch)
    long = "word " * 20000
    rows = [("b", 0, "chapter_title", "1. Rome"), ("b", 1, "paragraph", f"a<sup>1</sup> {long} b<sup>x</sup> c<sup>*</sup>"), ("b", 2, "chapter_title", "Notes"), ("b", 3, "subtitle", "Chapter 1"), ("b", 4, "paragraph", f"1. {long}"), ("b", 9, "note", f"* {long}")]
    got = linking.link(spark.createDataFrame(rows, "book string, pos long, kind string, text string"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1, 0, "1", "chapter", 4, 1), (1, 2, "*", "symbol", 9, 2)]
    assert seen and _written(seen) < 5000


def test_chapter_scans_carry_no_texts(spark, monkeypatch):
    seen = _scanned(monkeypatch)
    long = "word " * 20000
    rows = [*BOOK, (1, 1, "main_text", long), (4, 3, "main_text", f"6. {long}"), (5, 2, "main_text", f"Epilogue\n2. {long}"), (5, 3, "main_text", long)]
    got = {r.n if r.n is not None else r.title: (r.missing_entries, r.missing_sups) for r in chapters.chapter_review(areas(spark, rows), spark.createDataFrame([("b", 3)], "book string, start long")).collect()}
    assert got == {1: ("4", "3"), 9: ("", "5"), "epilogue": ("", "2,6")}
    assert len(seen) > 1 and _written(seen) < 5000
