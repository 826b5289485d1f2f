import numpy as np
import pandas as pd

from lumora.operators import scan, segment
from lumora.sources import files

RNG = np.random.default_rng(6)


def test_red_ink_goes_and_the_rest_stays(spark):
    x = np.full((20, 30, 3), 255, np.uint8)
    x[2:5, 2:5], x[10:14, 10:14], x[16, 20] = (200, 20, 20), (10, 10, 10), (20, 20, 200)
    rows = spark.createDataFrame(pd.DataFrame({"image_id": [1, 2, 3], "width": [30, 30, 30], "height": [20, 20, 20], "pixels": [x.tobytes(), None, b"123"]}))
    assert {r.image_id: r.n_red for r in scan.red_pixels(rows).collect()} == {1: 9, 2: None, 3: None}
    got = {r.image_id: r.pixels for r in scan.processed(rows, "without_red").collect()}
    y = scan.image(30, 20, got[1])
    assert (y[1:6, 1:6] == 255).all() and (y[10:14, 10:14] == 10).all() and (y[16, 20] == (20, 20, 200)).all() and got[2] is None and got[3] is None


def test_hsv_against_colorsys():
    import colorsys

    x = RNG.integers(0, 256, (8, 8, 3), dtype=np.uint8)
    for p, (h, s, v) in zip(x.reshape(-1, 3), scan.hsv(x).reshape(-1, 3)):
        a, b, c = colorsys.rgb_to_hsv(*(p / 255))
        assert min(abs(a * 180 - h), 180 - abs(a * 180 - h)) <= 0.51 and abs(b * 255 - s) <= 0.51 and c * 255 == v


def test_threshold_pixel_by_pixel():
    x = RNG.integers(0, 256, (40, 50), dtype=np.uint8)
    sigma = 0.3 * ((31 - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(31) - 15) ** 2) / (2 * sigma**2))
    k = np.outer(k, k) / k.sum() ** 2
    p = np.pad(x.astype(float), 15, mode="reflect")
    for i, j in ((0, 0), (20, 25), (39, 49), (7, 3)):
        mean = round((p[i : i + 31, j : j + 31] * k).sum())
        assert scan.thresholded(x)[i, j] == (255 if x[i, j] > mean - 12 else 0)
    flat = np.full((9, 9), 77, np.uint8)
    assert (scan.light(flat) == 77).all() and (scan.thresholded(flat) == 255).all()
    two = np.where(RNG.random((30, 30)) < 0.5, 40, 200).astype(np.uint8)
    assert ((scan.otsu(two) == 255) == (two == 200)).all()


def test_pages_engines_and_errors(spark):
    def raster(content: bytes, dpi: int):
        if content == b"bad":
            raise ValueError("no pages")
        return [(2, 1, content[i : i + 2]) for i in range(0, len(content), 2)]

    def engine(x):
        if x.ravel()[0] == 0:
            raise RuntimeError("blank")
        return f"page {x.ravel().tolist()}"

    docs = spark.createDataFrame([("a", bytearray([1, 2, 0, 0, 5, 6])), ("b", bytearray(b"bad")), ("c", bytearray())], "path string, content binary")
    pages = scan.rasterised(docs, raster)
    got = sorted((r.path, r.page_no, r.text, r.error) for r in scan.recognised(pages, engine).collect())
    assert got == [("a", 0, "page [1, 2]", None), ("a", 1, "", None), ("a", 2, "page [5, 6]", None), ("b", 0, "", "no pages")]
    rows = [("d", 0, "one two", None), ("d", 1, None, None), ("e", 0, "x", None), ("e", 1, "y", "broken")]
    text = {r.doc_id: (r.text, r.n_pages, r.error) for r in scan.page_concat(spark.createDataFrame(rows, "doc_id string, page_no int, text string, error string")).collect()}
    assert text == {"d": (f"one two\n{segment.PAGE_BREAK}\n\n{segment.PAGE_BREAK}\n", 2, None), "e": ("", 2, "broken")}


def test_slow_pages_switch_engines(spark):
    rows = [("d", 0, "many good words here", "few", 5.0), ("d", 1, "many good words here", "few", 130.0), ("d", 2, "many good words here", "few", 1.0), ("e", 0, None, None, None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_no int, text_a string, text_b string, seconds double")
    got = {(r.doc_id, r.page_no): (r.text, r.slow) for r in scan.chosen_texts(pages, 120.0).collect()}
    assert got["d", 1] == ("many good words here", False) and got["d", 2] == ("few", True) and got["e", 0][1] is False
    assert not any(r.slow for r in scan.chosen_texts(pages).collect())


def test_strategies(spark):
    x = np.full((40, 40), 200, np.uint8)
    x[10:20, 10:20] = 30
    rows = spark.createDataFrame(pd.DataFrame({"image_id": [1], "width": [40], "height": [40], "pixels": [x.tobytes()]}))
    got = {r.strategy: r.text for r in scan.strategies(rows, lambda y: f"word {(y < 128).sum()}").collect()}
    assert got["otsu"] == got["raw"] == "word 100" and set(got) == {"otsu", "threshold", "raw"}


def test_uploads_and_latest(spark, tmp_path):
    for name, content in (("e1/student_file.txt", "1. a"), ("e1/model_file.txt", "1. b"), ("e2/student_file.txt", "2"), ("e2/model_file.txt", ""), ("e2/other.txt", "x"), ("scans/p.PNG", "x"), ("scans/p.png", "y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    up = files.uploads(spark, str(tmp_path))
    assert {(r.exam, r.status, tuple(sorted(r.missing))) for r in files.upload_states(up).collect()} == {("e1", 202, ()), ("e2", 400, ("model_file",))}
    assert [r.path.rsplit("/", 1)[1] for r in files.scans(spark, str(tmp_path)).collect()] == ["p.png"]
    assert {r.text for r in files.whole_texts(spark, str(tmp_path / "e1")).collect()} == {"1. a", "1. b"}
    f = spark.createDataFrame([("p", 1, "a"), ("q", 3, "a"), ("r", 3, "a"), ("s", 2, "b")], "path string, modified int, kind string")
    assert [r.path for r in files.latest(f).collect()] == ["r"] and {r.path for r in files.latest(f, "kind").collect()} == {"r", "s"}
    assert files.latest(f.where("false")).count() == 0
    files.write_report(spark.createDataFrame([(1, "2a", 5.0)], "exam_id int, q_key string, score double"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
