"""Text inputs, VCF text in its three wrappings, and bundles."""

import gzip
import hashlib
import shutil
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from coeval.operators.coordinates import Chromosome
from coeval.sinks.publish import publish, table_digest
from coeval.sources import bundles, text_inputs, vcf


def test_offsets():
    assert text_inputs.parse_offsets(["# x", "a 10", "b 5 # tail"]) == [Chromosome("a", 0, 10), Chromosome("b", 10, 5)]
    assert text_inputs.parse_offsets(["a 0 10", "b 12 5"])[1] == Chromosome("b", 12, 5)
    for bad in ([], ["a 1", "b 2 3"], ["a x"], ["a"], ["a 0 5", "a 9 5"]):
        with pytest.raises(ValueError):
            text_inputs.parse_offsets(bad)


def test_positions(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("# head\nchr1 5\n\n chr2\t7 # x\n")
    got = text_inputs.load_native_positions(spark, str(path))
    assert sorted(map(tuple, got.collect())) == [("chr1", 5), ("chr2", 7)]
    for text in ("chr1 5 6\n", "chr1 x\n", "chr1 0\n", "chr1 5\nchr1 5\n", "# nothing\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            text_inputs.load_native_positions(spark, str(path))


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.tsv"
    head = "label\tpositions\ttarget\toutput\tseed\n"
    path.write_text(head + "a.1\tp\tt1\to1\t3\nb\tp\tt2\to2\t-4\n")
    for name in (str(path), path.as_uri()):
        runs = text_inputs.load_manifest(spark, name)
        assert [(r["label"], r["seed"]) for r in runs] == [("a.1", "3"), ("b", "-4")]
    bad = {
        head: "no runs", "label\tseed\na\t1\n": "no column", head + "-x\tp\tt\to\t1\n": "malformed label", head + "a\tp\tt\to\tx\n": "no integer",
        head + "a\tp\tt\to\t1\nb\tp\tt\to2\t1\n": "repeated target", head + "a\tp\tt\to\t1\na\tp\tt2\to2\t1\n": "repeated label",
        head + "a\t\tt\to\t1\n": "empty positions", head + "a\tp\tt\t \t1\n": "empty output", head + "a\tp\tt\to\t1.5\n": "no integer",
    }
    for text, said in bad.items():
        path.write_text(text)
        with pytest.raises(ValueError, match=said):
            text_inputs.load_manifest(spark, str(path))


def test_expand(spark, tmp_path):
    for name in ("b1", "b0", "a0"):
        (tmp_path / name).touch()
    for base in (str(tmp_path), tmp_path.as_uri()):
        got = text_inputs.expand(spark, [f"{base}/b*", f"{base}/*"])
        assert [p[-2:] for p in got] == ["b0", "b1", "a0"]
    with pytest.raises(ValueError):
        text_inputs.expand(spark, [str(tmp_path / "none*")])


def test_offsets_by_uri(spark, tmp_path):
    (tmp_path / "o.txt").write_text("a 10\nb 5\n")
    assert text_inputs.load_offsets(spark, (tmp_path / "o.txt").as_uri()) == [Chromosome("a", 0, 10), Chromosome("b", 10, 5)]


def test_many_draws_are_one_scan(spark, tmp_path):
    from coeval import schema as layout
    from coeval.sources.tree_tables import load_draws

    base = tmp_path / "draws of run+1"
    ddl = {"nodes": layout.NODES, "edges": layout.EDGES, "sites": layout.DRAW_SITES, "mutations": layout.MUTATIONS}
    one = spark.range(1).select(F.lit(1).alias("n"))
    for name, columns in ddl.items():
        empty = spark.createDataFrame([], columns.split(", ", 1)[1])
        row = one.select(*[F.lit(7).cast(f.dataType).alias(f.name) for f in empty.schema.fields])
        row.coalesce(1).write.parquet(str(base / "first" / name))
    for i in range(74):
        shutil.copytree(base / "first", base / f"d{i:02d}")
    trees = load_draws(spark, [f"file://{base}/d*", str(base / "first")])
    assert trees.draws == 75
    assert sorted(r["draw_id"] for r in trees.sites.collect()) == list(range(75))
    assert trees.nodes.where("draw_id = 74").select(F.input_file_name()).first()[0].count("first") == 1
    plan = trees.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1 and "Union" not in plan


def block_gzip(data: bytes, size: int) -> bytes:
    out = b""
    for start in [*range(0, len(data), size), len(data)]:
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(data[start : start + size]) + deflate.flush()
        piece = data[start : start + size]
        header = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        out += header + body + struct.pack("<II", zlib.crc32(piece), len(piece))
    return out


@pytest.mark.parametrize("split", [37, 200, 1000, 1 << 20])
@pytest.mark.parametrize("ending", ["\n", ""])
def test_block_gzip_lines_survive_any_split(spark, tmp_path, split, ending):
    lines = [f"{'#' if i % 9 == 0 else ''}line {i} " + "x" * (i * 7 % 90) for i in range(120)]
    path = tmp_path / "t.vcf.bgz"
    path.write_bytes(block_gzip(("\n".join(lines) + ending).encode(), 150))
    got = sorted(r["value"] for r in vcf.read_lines(spark, str(path), split).collect())
    assert got == sorted(lines)


def test_vcf_wrappings_agree(spark, tmp_path):
    text = "##x\n#CHROM\nchr1\t5\t.\tA\tG\t.\t.\tAA=G;AA=A\tGT:DP\t0:1\t1:2\t.:3\nchr1\t9\t.\tC\tT\t.\t.\tAA=T\tDP:GT\t1:1\t2:0\t3\n"
    (tmp_path / "a.vcf").write_text(text)
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as handle:
        handle.write(text)
    (tmp_path / "a.vcf.bgzf").write_bytes(block_gzip(text.encode(), 40))
    asked = spark.createDataFrame([("chr1", 5), ("chr1", 9)], "chrom STRING, pos BIGINT")
    for name in ("a.vcf", "a.vcf.gz", "a.vcf.bgzf"):
        lines = vcf.read_lines(spark, str(tmp_path / name), 60)
        got = sorted(tuple(r) for r in vcf.site_counts(lines, asked, "info").collect())
        assert got == [("chr1", 5, 1, 2, None), ("chr1", 9, 1, 2, None)], name
    digests = {vcf.file_digest(spark, str(tmp_path / name)) for name in ("a.vcf", "a.vcf.gz", "a.vcf.bgzf")}
    assert len(digests) == 3
    parts = [hashlib.sha256(text.encode()[i : i + 50]).digest() for i in range(0, len(text), 50)]
    assert vcf.file_digest(spark, str(tmp_path / "a.vcf"), 50) == "sha256-of-50:" + hashlib.sha256(b"".join(parts)).hexdigest()


def test_damaged_block_gzip_is_never_read_in_part(spark, tmp_path):
    text = "".join(f"chr1\t{i}\t{'y' * (i % 40)}\n" for i in range(400)).encode()
    whole = bytes(block_gzip(text, 600))
    starts = [0]
    while starts[-1] < len(whole):
        starts.append(starts[-1] + vcf._block_size(whole[starts[-1] :]))
    assert starts[-1] == len(whole) and len(starts) > 10
    middle = starts[5]
    spoiled = bytearray(whole)
    spoiled[middle : middle + 2] = b"\0\0"
    crc = bytearray(whole)
    crc[starts[6] - 8] ^= 1
    cases = {
        "header.bgz": bytes(spoiled),
        "crc.bgz": bytes(crc),
        "cut.bgz": whole[: middle + 9],
        "between.bgz": whole[:middle],
        "last.vcf.gz": whole[: starts[-2]],
        "plain.bgz": gzip.compress(text),
        "text.bgz": text,
        "first.bgz": b"\x1f\x8b\x08\x04" + whole[40:],
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
        for split in (100, 1500, 1 << 20):
            with pytest.raises(Exception, match="block|gzip|compressed"):
                vcf.read_lines(spark, str(tmp_path / name), split).collect()
    (tmp_path / "good.vcf.gz").write_bytes(whole)
    lines = vcf.read_lines(spark, str(tmp_path / "good.vcf.gz"), 1500)
    assert lines.rdd.getNumPartitions() > 1
    assert sorted(r["value"] for r in lines.collect()) == sorted(text.decode().splitlines())


def test_scan_of_many_requests_shuffles_numbers_only(spark, monkeypatch):
    rows = [f"c\t{i}\t.\tA\tG\t.\t.\tAA=A\tGT\t{i % 2}\t1" for i in range(40)] + ["c", "c\t9\t.\tA\tG\t.\t.\t.\tGT\t0/1\t1"]
    frame = spark.createDataFrame([(x,) for x in rows], "value STRING")
    asked = spark.createDataFrame([("c", i) for i in range(3, 30)], "chrom STRING, pos BIGINT")
    few = sorted((tuple(r) for r in vcf.site_counts(frame, asked).collect()), key=str)
    monkeypatch.setattr(vcf, "SMALL_REQUEST", 0)
    many = vcf.site_counts(frame, asked)
    assert sorted((tuple(r) for r in many.collect()), key=str) == few and len(few) == 29
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("Join")
    assert "samples" not in plan[:joined]


def test_vcf_problems(spark):
    record = lambda pos, alt="G", info="AA=A", form="GT", calls="0\t1", ref="A": f"c\t{pos}\t.\t{ref}\t{alt}\t.\t.\t{info}\t{form}\t{calls}"
    lines = [
        record(1), record(2, alt="G,T"), record(3, info="."), record(4, info="AA=a"), record(5, form="DP"),
        record(6, calls="0/1\t1"), record(7, calls="2\t1"), record(8, calls="x\t1"), "c\t9\t.\tA", record(10), record(10),
    ]
    frame = spark.createDataFrame([(x,) for x in lines], "value STRING")
    asked = spark.createDataFrame([("c", i) for i in range(1, 12)], "chrom STRING, pos BIGINT")
    got = {r["pos"]: r["problem"] for r in vcf.site_counts(frame, asked, "info").collect()}
    assert got == {
        1: None, 2: "multiallelic record", 3: "missing or ambiguous ancestral allele",
        4: "ancestral allele is neither REF nor ALT", 5: "record lacks GT", 6: "heterozygous genotype",
        7: "non-biallelic genotype", 8: "invalid genotype", 9: "no samples or FORMAT", 10: None,
    }
    missing = vcf.completeness_problems(asked, vcf.site_counts(frame, asked, "info"))
    assert sorted((r["pos"], r["problem"]) for r in missing.collect()) == [(10, "duplicate record"), (11, "absent")]
    broken = spark.createDataFrame([("#h",), ("c\tx\t.",), ("c",), ("c\t1\t.",)], "value STRING")
    assert sorted(r["value"] for r in vcf.malformed_records(broken).collect()) == ["c", "c\tx\t."]
    found = vcf.site_counts(broken, asked).collect()
    assert sorted((r["problem"], r["pos"] is None) for r in found) == [
        ("malformed record", True), ("malformed record", True), ("no samples or FORMAT", False)
    ]


def test_bundles(spark, tmp_path):
    frame = spark.range(50).withColumnRenamed("id", "row_id")
    where = str(tmp_path / "b")
    publish(spark, where, bundles.TARGET, {"rows": frame}, {"note": 1})
    bundle = bundles.open_bundle(spark, where, bundles.TARGET, deep=True)
    assert bundle.table("rows").count() == 50 and bundle.metadata["note"] == 1
    assert table_digest(frame) == table_digest(frame.repartition(7)) != table_digest(frame.where("row_id > 0"))
    with pytest.raises(FileExistsError):
        publish(spark, where, bundles.TARGET, {"rows": frame}, {})
    with pytest.raises(ValueError, match="unsupported"):
        bundles.open_bundle(spark, where, bundles.CONTROLS)
    with pytest.raises(FileNotFoundError):
        bundles.open_bundle(spark, str(tmp_path))
    frame.where("row_id < 9").write.mode("append").parquet(f"{where}/rows")
    with pytest.raises(ValueError, match="digest"):
        bundle.verify()
    assert not list(tmp_path.glob("*.staging-*"))
