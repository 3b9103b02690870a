"""WARC ranges of every size: each record is read once, whatever payloads quote; sharding by bytes with repeated rows."""

import zlib

import pyarrow as pa
import pytest

from stancemill.llm import sharding, warc


def records():
    head = lambda k, kind="resource": {"WARC-Type": kind, "WARC-Record-ID": f"<{k}>"}
    quoted = b"text\r\n\r\nWARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <no>\r\nContent-Length: 5\r\n\r\nhello and more"
    half = b"\r\n\r\nWARC/1.1\r\nno head at all"
    whole = warc.record_bytes(head("inner"), b"inside") + b"tail"
    blocks = [b"", b"z" * 40, quoted, half, b"\r\n\r\n", whole, b"y" * 3, b"x" * 70]
    return [warc.record_bytes(head(k), b) for k, b in enumerate(blocks)], blocks


@pytest.mark.parametrize("kind", ["plain", "zipped", "unlisted"])
def test_every_range_size(tmp_path, kind, monkeypatch):
    rows, blocks = records()
    made = {"plain": lambda r: r, "zipped": warc.member, "unlisted": lambda r: zlib.compress(r, wbits=31)}[kind]
    raw = b"".join(map(made, rows))
    path = tmp_path / ("a.warc" if kind == "plain" else "a.warc.gz")
    path.write_bytes(raw)
    for size in range(1, len(raw) + 1):
        reader = warc.WarcReader({"path": str(path), "rangebytes": str(size)})
        opened = []
        with monkeypatch.context() as m:
            m.setattr(warc, "MEMBER", None)  # planning looks into no file
            parts = reader.partitions()
        assert len(parts) == -(-len(raw) // size) and not opened
        got = [r for p in parts for b in reader.read(p) for r in pa.Table.from_batches([b]).to_pylist()]
        assert [(r["record_id"], r["payload"]) for r in got] == [(f"<{k}>", b) for k, b in enumerate(blocks)], size


@pytest.mark.parametrize("repeats", [400, 4000])
def test_bytes_law_with_repeated_rows(spark, repeats):
    rows = [(k, f"text {k} " + "a" * (k % 13)) for k in range(400)] + [(7777, "b" * 99)] * repeats + [(None, None)] * 50 + [(None, "n" * 20)] * 30
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(loads) - min(loads) <= max(0.01 * sum(loads) / 8, 2 * 100)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in got) == sorted((i is None, i, len(t or "") + 1) for i, t in rows)


def test_edited_map_against_a_plain_fold(spark):
    """Slots by falling bytes: each stays while its shard does not pass the mean, else goes to the lightest shard, the first on ties."""
    old = [(k, k % 5) for k in range(60)]
    sizes = {k: (k * 37) % 23 * 10 for k in range(60) if k % 7}
    for shards in (3, 5, 8):
        mean = -(-sum(sizes.values()) // shards)
        loads, expected = [0] * shards, {}
        for k, at in sorted(old, key=lambda x: (-sizes.get(x[0], 0), x[0])):
            n = sizes.get(k, 0)
            to = at if at < shards and loads[at] + n <= mean else loads.index(min(loads))
            loads[to] += n
            expected[k] = (to, n)
        got = sharding.edited_map(spark.createDataFrame(old, "virtual_slot int, shard int"), spark.createDataFrame(list(sizes.items()), "virtual_slot int, bytes long"), shards)
        assert {r["virtual_slot"]: (r["shard"], r["bytes"]) for r in got.collect()} == expected


@pytest.fixture(scope="module")
def html_model():
    from stancemill.llm import html

    return html.default_model()


def test_controls_and_open_quotes(html_model):
    from stancemill.llm import html

    page = """<article><p><i class="q>The first part of a long story that goes on and on, with many words in it.</p>
    <p>It is here that the story ends, <a title='x > y' href='/b'>with a link</a> and <button type=button>Share</button> more of the text<select><option>One<option>Two</select> that matters.</p></article>"""
    assert html.main_text(page, html_model).split("\n") == [
        "The first part of a long story that goes on and on, with many words in it.",
        "It is here that the story ends, with a link and more of the text that matters.",
    ]
    assert [b.text for b in html.blocks("<p>a<button>b</button>c</p><button/>d")] == ["ac", "d"]


def test_features_have_one_order():
    from stancemill.llm import html

    html.path_features.cache_clear()
    got = html.path_features(("div z y x", "article main"))
    assert list(got) == sorted(got)
