"""Chunkers against sequential versions written here, and readers on small files."""

import random
import re

from pyspark.sql import functions as F

from lexiforge.config import Settings
from lexiforge.operators import structure as S
from lexiforge.sources import files, sinks

CFG = Settings(chunk_size=60, chunk_overlap=15, max_chunk=90, min_chunk=20)


def pages_of(seed, n=40):
    r = random.Random(seed)
    words = ["alpha", "beta.", "gamma!", "delta", "epsilon zeta?", "eta"]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(n)], [r.choice(["S1", "S1", "S2"]) for _ in range(n)]


def sequential_pages(pages, sections, cfg):
    out, cur, at, sec = [], "", [], None
    for i, (p, s) in enumerate(zip(pages, sections, strict=True), 1):
        if s != sec and cur:
            if len(cur) > 100:
                out.append((cur, list(at), sec))
            cur, at = "", []
        sec = s
        if len(cur) + len(p) <= cfg.max_chunk:
            cur, at = cur + f"\n[Page {i}]\n{p}", [*at, i]
        else:
            if cur:
                out.append((cur, list(at), sec))
            cur, at = (cur[-cfg.chunk_overlap :] if len(cur) > cfg.chunk_overlap else "") + f"\n[Page {i}]\n{p}", [i]
    if cur and len(cur) > 100:
        out.append((cur, list(at), sec))
    return out


def test_page_chunks(spark):
    for seed in range(3):
        pages, sections = pages_of(seed)
        rows = spark.createDataFrame([("d", i, p, s) for i, (p, s) in enumerate(zip(pages, sections, strict=True), 1)], "path string, page_id int, text string, section string")
        got = [(r.text, r.pages, r.section) for r in S.page_chunks(rows, CFG).orderBy("chunk_no").collect()]
        assert got == sequential_pages(pages, sections, CFG)


def sequential_elements(elements, cfg):
    out, cur, pages, sec = [], "", [], ""
    for kind, text, page in elements:
        if kind in ("table", "heading") and cur and len(cur) >= cfg.min_chunk:
            out.append((cur, list(pages), sec))
            cur, pages = "", []
        if kind == "table":
            out.append((text, [page], sec))
            continue
        if kind == "heading":
            sec = text
        if len(cur) + len(text) + 1 > cfg.max_chunk:
            if len(cur) >= cfg.min_chunk:
                out.append((cur, list(pages), sec))
            tail = cur[-cfg.chunk_overlap :] if cur else ""
            cur, pages = (tail + "\n" + text if tail else text), [page]
        else:
            cur = cur + "\n" + text if cur else text
            pages = pages if page in pages else [*pages, page]
        if len(cur) >= cfg.chunk_size:
            out.append((cur, list(pages), sec))
            cur, pages = cur[-cfg.chunk_overlap :], [page]
    if cur and len(cur) >= cfg.min_chunk:
        out.append((cur, list(pages), sec))
    return out


def test_element_chunks(spark):
    for seed in range(3):
        texts, _ = pages_of(seed)
        r = random.Random(seed)
        elements = [(r.choice(["heading", "table", "paragraph", "paragraph", "list"]), t or "x", i // 5 + 1) for i, t in enumerate(texts)]
        rows = spark.createDataFrame([("d", i, *e) for i, e in enumerate(elements)], "path string, ord int, element_type string, content string, page_number int")
        got = [(x.text, x.pages, x.section) for x in S.element_chunks(rows, CFG).orderBy("chunk_no").collect()]
        assert got == sequential_elements(elements, CFG)


def sentences(text, most):
    if len(text) <= most:
        return [text]
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len(cur) + len(s) <= most:
            cur = cur + " " + s if cur else s
            continue
        if cur:
            out.append(cur.strip(" "))
        if len(s) > most:
            out += [s[i : i + most] for i in range(0, len(s), most)]
            cur = ""
        else:
            cur = s
    return [*out, cur.strip(" ")] if cur else out


def sequential_hierarchy(pages, sections, cfg):
    out, cur, at, sec = [], "", [], None
    for i, (p, s) in enumerate(zip(pages, sections, strict=True), 1):
        if s != sec and cur:
            if len(cur) >= cfg.min_chunk:
                out.append((cur, list(at), sec))
            cur, at = "", []
        sec = s
        for piece in sentences(p, cfg.chunk_size):
            if len(cur) + len(piece) <= cfg.max_chunk:
                cur = cur + f"\n[Page {i}]\n{piece}" if cur else piece
                at = at if i in at else [*at, i]
            else:
                if len(cur) >= cfg.min_chunk:
                    out.append((cur, list(at), sec))
                cur, at = (cur[-cfg.chunk_overlap :] if len(cur) > cfg.chunk_overlap else "") + piece, [i]
    if cur and len(cur) >= cfg.min_chunk:
        out.append((cur, list(at), sec))
    return [(" ".join(t.split()), a, s, len(t)) for t, a, s in out]


def test_hierarchical_chunks(spark):
    for seed in range(3):
        pages, sections = pages_of(seed)
        rows = spark.createDataFrame([("d", i, p, s) for i, (p, s) in enumerate(zip(pages, sections, strict=True), 1)], "path string, page_id int, text string, section string")
        got = [(r.text, r.pages, r.section, r.char_count) for r in S.hierarchical_chunks(rows, CFG).orderBy("chunk_no").collect()]
        assert got == sequential_hierarchy(pages, sections, CFG)


def test_hierarchical_chunks_bounds(spark):
    pages, sections = pages_of(9)
    rows = spark.createDataFrame([("d", i, p, s) for i, (p, s) in enumerate(zip(pages, sections, strict=True), 1)], "path string, page_id int, text string, section string")
    got = S.hierarchical_chunks(rows, CFG).collect()
    assert got and all(CFG.min_chunk <= r.char_count <= CFG.max_chunk + CFG.chunk_overlap + 20 for r in got)


def test_merge(spark):
    rows = spark.createDataFrame([("d", 0, "a" * 10, [1], "S"), ("d", 1, "b" * 10, [2], "S"), ("d", 2, "c" * 10, [3], "T"), ("d", 3, "d" * 50, [4], "T")], "path string, chunk_no int, text string, pages array<int>, section string")
    got = [(r.text, r.pages) for r in S.merge_chunks(rows, 30).orderBy("chunk_no").collect()]
    assert got == [("a" * 10 + "\n" + "b" * 10, [1, 2]), ("c" * 10, [3]), ("d" * 50, [4])]


def test_sections_and_fixed(spark):
    docs = spark.createDataFrame([(1, "1.1 Scope\nbody\n2 Terms\nmore")], "doc_id long, text string")
    got = [r.section for r in S.page_sections(S.lines_of(docs)).orderBy("page_id").collect()]
    assert got == ["1.1 Scope", "1.1 Scope", "2 Terms", "2 Terms"]
    assert [r.chunk for r in S.fixed_chunks(docs, 10).orderBy("pos").collect()] == [docs.first().text[i : i + 10].strip(" ") for i in range(0, 27, 10)]
    assert S.fixed_chunks(spark.createDataFrame([(1, "")], "doc_id long, text string")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.HTML").write_text("<html><nav>x</nav><h1>T &amp; U</h1><p>one<br>two</p><script>no</script></html>")
    (tmp_path / "sub/b.md").write_text("# H\n\n- item *bold* [link](u) `code`\n```\nx\n```\n1. num")
    (tmp_path / "c.txt").write_bytes(b"plain \xff text")
    (tmp_path / "d.pdf").write_bytes(b"p1\x0c \x0cp3")
    (tmp_path / "e.bin").write_bytes(b"zz")
    parser = lambda content: content.decode().split("\x0c")
    rows = {(r.path.rsplit("/", 1)[1], r.page_id): r.text for r in files.read_pages(spark, str(tmp_path), {"pdf": parser}).collect()}
    assert rows["a.HTML", 1] == "T & U one two" and rows["c.txt", 1] == "plain  text"
    assert rows["d.pdf", 1] == "p1" and rows["d.pdf", 2] == "p3" and len(rows) == 5
    text = spark.createDataFrame([("# H\n\n- item *bold* [link](u) `code`\n1. num",)], "t string")
    assert text.select(files.markdown_plain(F.col("t"))).first()[0] == "H\nitem bold link\nnum"


def test_index_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "idx long, text string")
    sinks.save_index({"chunks": frame}, str(tmp_path))
    back = sinks.load_index(spark, str(tmp_path), ["chunks", "vectors"])
    assert list(back) == ["chunks"] and back["chunks"].count() == 2
    more = spark.createDataFrame([(2, "b"), (3, "c")], "idx long, text string")
    sinks.append_batch(more, f"{tmp_path}/chunks", "idx")
    assert sorted(r.idx for r in spark.read.parquet(f"{tmp_path}/chunks").collect()) == [1, 2, 3]
    sinks.save_jsonl(frame, f"{tmp_path}/json")
    sinks.save_csv_each(frame, f"{tmp_path}/csv", "idx")
    assert spark.read.json(f"{tmp_path}/json").count() == 2 and (tmp_path / "csv/idx=1").exists()
