"""Normalisation, ingestion, catalogue store and streaming imports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gearledger.functions.specs import display
from gearledger.plans.ingest import changes, dry_run, ingest, repeatable, sync
from gearledger.plans.normalize import normalize_curated, normalize_export, normalize_open_db, validate_export, validate_open_db
from gearledger.sources.readers import read_curated, read_envelope, read_export, read_id_database, read_open_db, read_sitemap
from gearledger.sources.writers import CatalogStore, log_errors, log_run, write_lanes, write_sorted
from gearledger.streaming.imports import counters, counters_to_table, file_stream, import_stream

CPU = {
    "opendb_id": "ae9507b0-cdbc-489b-b39a-46b12687d53d",
    "metadata": {"name": "Intel Core i5 6400", "manufacturer": "Intel", "part_numbers": ["BX80662I56400", " BX80662I56400 "], "series": "Core i5 6000",
                 "variant": "6400", "releaseYear": 2015},
    "socket": "LGA 1151", "cores": {"total": 4, "threads": 4}, "specifications": {"tdp": 65}, "colour": "blue",
    "general_product_information": {"manufacturer_url": "https://intel.example/product", "amazon_sku": "DO-NOT-IMPORT"},
}


@pytest.fixture(scope="module")
def open_db(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("open")
    files = {
        "CPU/a.json": json.dumps(CPU), "CPU/broken.json": "{not json", "Fridge/b.json": json.dumps(CPU | {"opendb_id": CPU["opendb_id"][:-1] + "1"}),
        "CPU/c.json": json.dumps(CPU | {"opendb_id": "not-a-uuid"}),
        "Monitor/d.json": json.dumps({"opendb_id": CPU["opendb_id"][:-1] + "2", "metadata": {"name": "Screen", "manufacturer": "LG"}, "screen_size": 27, "hdr": True, "odd": 1}),
        "SoundCard/e.json": json.dumps({"opendb_id": CPU["opendb_id"][:-1] + "3", "metadata": {"name": "Card", "manufacturer": "C", "part_numbers": [70]}, "bits": 24}),
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(content)
    return str(root)


def test_open_database_files(spark, open_db):
    records, errors = read_open_db(spark, open_db)
    assert [(r.folder, r.file_id) for r in errors.collect()] == [("CPU", "broken")]
    valid, refused = validate_open_db(records)
    assert {(r.file_id, tuple(r.errors)) for r in refused.collect()} == {("b", ("category",)), ("c", ("opendb_id",))}
    rows = {r.source_record_id[-1]: r for r in normalize_open_db(valid).collect()}
    cpu = rows["d"]
    assert (cpu.category, cpu.mpn, cpu.part_numbers, cpu.model, str(cpu.release_date)) == ("cpu", "BX80662I56400", ["BX80662I56400"], "6400", "2015-01-01")
    assert cpu.slug == "intel-core-i5-6400-ae9507b0" and cpu.specs["socket"].s == "LGA 1151" and json.loads(cpu.specs["cores"].s) == {"total": 4, "threads": 4}
    assert set(cpu.specs) == {"socket", "cores", "specifications"}
    assert json.loads(cpu.raw)["general_product_information"] == {"manufacturer_url": "https://intel.example/product"}
    # 25 + 15 brand + 25 number + 9 specs; 78 * 0.75 + 74 * 0.25
    assert (cpu.completeness, cpu.confidence, cpu.missing_image, cpu.needs_review) == (74, 77, True, False)
    assert set(rows["2"].specs) == {"screen_size", "hdr"} and rows["2"].missing_mpn and rows["2"].mpn is None
    assert rows["3"].part_numbers == ["70"] and set(rows["3"].specs) == {"bits"}


def test_two_passes_give_one_identity(spark, open_db):
    valid, _ = validate_open_db(read_open_db(spark, open_db)[0])
    first, second = (normalize_open_db(valid).select("record_id", "identity_hash", "slug").orderBy("record_id").collect() for _ in range(2))
    assert first == second


EXPORT = {"icecat_id": "77", "category": "cpu", "brand": "Intel", "mpn": "BX80662I56400", "name": "Core i5-6400", "ean": "5032037076142", "description": "Old chip",
          "specifications": {"socket": "LGA1151", "tdp": 65}, "images": {"main": "https://i.example/a.png", "gallery": []}, "license": "open"}


def test_export_as_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([EXPORT, EXPORT | {"icecat_id": "78", "mpn": ""}], indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(EXPORT | {"icecat_id": str(i)}) for i in (1, 2)) + "\n")
    ok, bad = validate_export(read_export(spark, str(tmp_path / "a.json")))
    row = normalize_export(ok).first()
    assert (row.source_record_id, row.completeness, row.confidence, row.missing_image, row.specs["tdp"].n) == ("77", 84, 83, False, 65.0)
    assert [r.errors for r in bad.collect()] == [["mpn"]]
    assert read_export(spark, str(tmp_path / "b.jsonl")).count() == 2


def curated(spark):
    rows = [{"product_id": "cpu-6400", "category": "cpu", "brand": "Intel", "name": "Intel Core i5-6400", "reference": "BX80662I56400", "series": "Skylake", "year": 2015,
             "confidence": "Bonne", "notes": "", "usage": "Bureau", "specs": {"Socket": "LGA1151", "TDP": 65, "Cœurs": 4}},
            {"product_id": "x", "category": "expansion", "brand": "T", "name": "Card", "reference": "À vérifier", "confidence": "Faible", "specs": {}}]
    return rows


def test_curated_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in curated(spark)))
    rows = {r.source_record_id: r for r in normalize_curated(read_curated(spark, str(tmp_path / "c.json"))).collect()}
    assert (rows["cpu-6400"].source_confidence, rows["cpu-6400"].completeness, rows["cpu-6400"].confidence) == (92, 69, 86)
    assert (rows["x"].category, rows["x"].subcategory, rows["x"].mpn, rows["x"].missing_specs, rows["x"].needs_review) == ("network", "expansion", None, True, True)


@pytest.fixture(scope="module")
def three_waves(spark, open_db, tmp_path_factory):
    root = tmp_path_factory.mktemp("waves")
    (root / "c.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in curated(spark)))
    (root / "e.jsonl").write_text(json.dumps(EXPORT))
    valid, _ = validate_open_db(read_open_db(spark, open_db)[0])
    ok, _ = validate_export(read_export(spark, str(root / "e.jsonl")))
    return [normalize_curated(read_curated(spark, str(root / "c.json"))), normalize_open_db(valid), normalize_export(ok)]


def test_waves_merge_by_priority(spark, three_waves):
    tables, outcomes = sync(spark, three_waves, None, "2024-01-01")
    counts = {(r.source_key, r.outcome): r["count"] for r in outcomes.groupBy("source_key", "outcome").count().collect()}
    assert counts == {("curated", "created"): 2, ("open_db", "updated"): 1, ("open_db", "created"): 2, ("export", "updated"): 1}
    cpu = tables.components.filter("category = 'cpu'").first()
    # the curated name stays; what the curated source lacks comes from the next sources
    assert (cpu.name, cpu.description, cpu.ean, cpu.media_main, cpu.primary_source) == ("Intel Core i5-6400", "Old chip", "5032037076142", None, "curated")
    assert cpu.specs["socket"].s == "LGA 1151" and cpu.specs["Socket"].s == "LGA1151" and cpu.completeness == 84 and cpu.confidence == 86
    assert tables.components.count() == 4 and tables.sources.count() == 6
    provenance = {r.key: r.source for r in tables.fields.filter(F.col("component_id") == cpu.component_id).collect()}
    assert provenance["name"] == "curated" and provenance["description"] == "export" and provenance["specifications.socket"] == "open_db"


def test_replay_changes_nothing(spark, three_waves):
    tables, _ = sync(spark, three_waves, None, "2024-01-01")
    again, outcomes = ingest(repeatable(three_waves[1].unionByName(three_waves[1])), tables, "2024-02-01")
    assert {r.outcome for r in outcomes.collect()} == {"updated"}
    pick = ["component_id", "name", "brand", "mpn", "completeness", "confidence", "part_numbers"]
    assert sorted(map(tuple, again.components.select(*pick).collect())) == sorted(map(tuple, tables.components.select(*pick).collect()))
    assert again.identifiers.count() == tables.identifiers.count()
    dates = {(r.first_seen, r.last_seen) for r in again.sources.filter("source_key = 'open_db'").collect()}
    assert dates == {("2024-01-01", "2024-02-01")}


def test_later_equal_priority_wins_and_media_of_equal_priority(spark, three_waves):
    older = three_waves[2]
    newer = older.withColumns({"source_record_id": F.lit("99"), "record_id": F.lit("zz"), "read_order": F.lit("zz"), "description": F.lit("New text"), "media_main": F.lit(None).cast("string")})
    tables, _ = sync(spark, [older, newer], None, "2024-01-01")
    row = tables.components.first()
    assert (tables.components.count(), row.description, row.media_main) == (1, "New text", None)


def test_store_and_stream_equal_batch(spark, three_waves, tmp_path):
    folder = str(tmp_path / "in")
    three_waves[1].repartition(2).write.parquet(folder)
    store = CatalogStore(spark, str(tmp_path / "catalogue"))
    assert store.read() is None
    stream = file_stream(spark, folder, three_waves[1].schema, files_per_batch=1)
    import_stream(stream, lambda df: df, store, str(tmp_path / "checkpoint"), "2024-01-01", str(tmp_path / "log")).awaitTermination()
    batch, _ = ingest(three_waves[1], None, "2024-01-01")
    pick = ["component_id", "name", "completeness", "search_document"]
    assert sorted(map(tuple, store.read().components.select(*pick).collect())) == sorted(map(tuple, batch.components.select(*pick).collect()))
    versions = store.versions()
    assert len(versions) >= 1 and store.write(store.read(), "other/0") == f"v{int(versions[-1][1:]) + 1:012d}"
    assert store.write(store.read(), "other/0") is None
    versions = store.versions()
    # nothing new: the same query adds no version
    import_stream(file_stream(spark, folder, three_waves[1].schema), lambda df: df, store, str(tmp_path / "checkpoint"), "2024-01-01").awaitTermination()
    assert store.versions() == versions
    assert spark.read.parquet(str(tmp_path / "log")).agg(F.sum("created")).first()[0] == 3


def test_running_counters_go_on_after_a_restart(spark, three_waves, tmp_path):
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "counters", "checkpoint"))
    rows = three_waves[1].select("source_key", "category")
    want = lambda n: sorted((a, b, c * n) for a, b, c in map(tuple, rows.groupBy("source_key", "category").count().collect()))
    assert counters(spark, table) is None
    for turn in (1, 2, 3):
        rows.repartition(3).write.mode("append").parquet(folder)
        if turn == 2:
            # Categories that were there before and get nothing new stay as they are.
            spark.createDataFrame([("open_db", "new")], rows.schema).write.mode("append").parquet(folder)
        counters_to_table(file_stream(spark, folder, rows.schema, files_per_batch=2), table, checkpoint).awaitTermination()
        extra = [("open_db", "new", 1)] if turn > 1 else []
        assert sorted(map(tuple, counters(spark, table).collect())) == sorted(want(turn) + extra)


def small(spark, three_waves, n, start=0):
    """Records of their own: no code, name or source record is shared."""
    one = three_waves[2].limit(1)
    named = lambda c: F.concat(F.lit(c), F.col("i").cast("string"))
    codes = F.transform("codes", lambda c: F.struct(*[F.concat(c["value"], F.col("i").cast("string")).alias(f) if f == "value" else c[f].alias(f) for f in ("rank", "type", "value", "scope")]))
    rows = one.crossJoin(spark.range(start, start + n).withColumnRenamed("id", "i"))
    return rows.withColumns({"source_record_id": named("s"), "record_id": named("r"), "read_order": named("r"), "identity_hash": named("h"), "slug": named("slug"),
                             "codes": codes.cast(three_waves[2].schema["codes"].dataType)}).select(*one.columns)


def test_upsert_rewrites_touched_buckets_only(spark, three_waves, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "c"), buckets=64)
    store.upsert(lambda c: changes(small(spark, three_waves, 200), c, "2024-01-01")[0])
    before = store.manifest()
    store.upsert(lambda c: changes(small(spark, three_waves, 10, 195), c, "2024-02-01")[0], "other/3")
    after = store.manifest()
    for table in after["tables"]:
        old, new = before["tables"][table]["buckets"], after["tables"][table]["buckets"]
        assert 0 < sum(new[b] != old.get(b) for b in new) <= 10
    assert store.read().components.count() == 205 and store.read().sources.count() == 205
    dates = {(r.first_seen, r.last_seen): r["count"] for r in store.read().sources.groupBy("first_seen", "last_seen").count().collect()}
    assert dates == {("2024-01-01", "2024-01-01"): 195, ("2024-01-01", "2024-02-01"): 5, ("2024-02-01", "2024-02-01"): 5}
    assert store.committed("other/3") and store.committed("other/2") and not store.committed("other/4")
    assert store.read(before["version"]).components.count() == 200
    gone = store.vacuum(keep=1)
    assert store.versions() == [after["version"]] and store.read().components.count() == 205
    assert not set(gone) & {f for t in after["tables"].values() for f in t["buckets"].values()}


def test_two_writers_at_once_keep_all_rows(spark, three_waves, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "c")
    batches = [small(spark, three_waves, 8, 100 * n).cache() for n in range(3)]

    def work(n):
        # A store of its own, as another process would have; the same few components are fed by all.
        return CatalogStore(spark, path, buckets=8).upsert(lambda c: changes(batches[n], c, f"2024-01-0{n + 1}")[0], f"stream{n}/0")

    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(work, range(3)))
    store = CatalogStore(spark, path)
    assert sorted(versions) == store.versions() and len(versions) == 3
    assert {r.source_record_id for r in store.read().sources.collect()} == {f"s{100 * n + i}" for n in range(3) for i in range(8)}
    assert store.read().components.count() == 24 and all(store.committed(f"stream{n}/0") for n in range(3))


def test_a_slower_writer_works_on_what_the_faster_left(spark, three_waves, tmp_path):
    path, seen = str(tmp_path / "c"), []

    def slow(catalog):
        seen.append(None if catalog is None else catalog.sources.count())
        if len(seen) == 1:
            CatalogStore(spark, path).upsert(lambda c: changes(small(spark, three_waves, 4), c, "2024-01-01")[0], "fast/0")
        return changes(small(spark, three_waves, 4, 2), catalog, "2024-01-02")[0]

    store = CatalogStore(spark, path)
    assert store.upsert(slow, "slow/0") == "v000000000002" and seen == [None, 4]
    assert store.read().components.count() == 6 and store.upsert(slow, "slow/0") is None


def test_other_files(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps({"version": 2, "candidates": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}]}))
    assert [tuple(r) for r in read_envelope(spark, str(tmp_path / "feed.json"), "candidates", "id:string,label:string").collect()] == [(2, "a", "A"), (2, "b", "B")]
    (tmp_path / "map.xml").write_text('<?xml version="1.0"?><s:urlset xmlns:s="x"><s:url><s:loc> https://a.example/p </s:loc></s:url><s:url><s:loc>https://a.example/q</s:loc></s:url></s:urlset>')
    assert [r.url for r in read_sitemap(spark, str(tmp_path / "map.xml")).orderBy("position").collect()] == ["https://a.example/p", "https://a.example/q"]
    import gzip

    lines = [f"line {i}" for i in range(50)]
    (tmp_path / "ids.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    assert [r.line for r in read_id_database(spark, str(tmp_path / "ids.gz")).orderBy("line_no").collect()] == lines
    frame = spark.range(20).withColumn("lane", F.when(F.col("id") % 4 == 0, "rejected").otherwise("candidates"))
    write_lanes(frame, str(tmp_path / "lanes"))
    assert sorted(n for n in os.listdir(tmp_path / "lanes") if n.startswith("lane=")) == ["lane=candidates", "lane=rejected"]
    write_sorted(frame, str(tmp_path / "sorted"), ["lane", "id"], "json")
    assert spark.read.json(str(tmp_path / "sorted")).count() == 20
    for run in ("r1", "r2"):
        log_run(spark.range(1), str(tmp_path / "runs"), run, "completed")
    log_errors(spark.range(3), str(tmp_path / "errors"), "r1")
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_split_text_file_keeps_line_order(spark, tmp_path):
    lines = [f"{i:06d} " + "x" * 50 for i in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = read_id_database(spark, str(tmp_path / "big.txt"))
        assert found.select("line").rdd.getNumPartitions() >= 1
        assert [r.line for r in found.orderBy("line_no").collect()] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_streams_share_a_store(spark, three_waves, tmp_path):
    """Batches of a second stream have the same numbers and are not taken for those of the first."""
    store = CatalogStore(spark, str(tmp_path / "catalogue"))
    expected = set()
    for n, wave in enumerate(three_waves[:2]):
        folder = str(tmp_path / f"in{n}")
        wave.repartition(1).write.parquet(folder)
        import_stream(file_stream(spark, folder, wave.schema), lambda df: df, store, str(tmp_path / f"checkpoint{n}"), "2024-01-01").awaitTermination()
        expected |= {(r.source_key, r.source_record_id) for r in wave.collect()}
    assert {(r.source_key, r.source_record_id) for r in store.read().sources.collect()} == expected
    assert len(store.versions()) == 2


def test_export_folder_may_mix_arrays_and_lines(spark, tmp_path):
    import json

    folder = tmp_path / "export"
    folder.mkdir()
    row = lambda i: {"icecat_id": str(i), "brand": "B", "name": f"n{i}", "specifications": {"a": i}}
    (folder / "b.json").write_text("\n [" + ",\n".join(json.dumps(row(i), indent=1) for i in range(2)) + "]")
    (folder / "a.jsonl").write_text("\n".join(json.dumps(row(i)) for i in range(2, 7)) + "\n\nnot json\n")
    (folder / "c.json").write_text("[{broken")
    rows = read_export(spark, str(folder)).collect()
    assert sorted(r.name for r in rows if r.name) == [f"n{i}" for i in range(7)]
    assert sorted(r._corrupt_record for r in rows if r._corrupt_record) == ["[{broken", "not json"]


def test_sitemap_entities_and_cdata(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<urlset><url><loc>\n https://a.example/p?x=1&amp;y=2 </loc></url><url><x:loc><![CDATA[https://a.example/q&z]]></x:loc></url><location>no</location></urlset>")
    assert [r.url for r in read_sitemap(spark, str(tmp_path / "m.xml")).orderBy("position").collect()] == ["https://a.example/p?x=1&y=2", "https://a.example/q&z"]


def test_open_db_files_may_span_lines(spark, tmp_path):
    import json

    (tmp_path / "CPU").mkdir()
    (tmp_path / "CPU" / "x.json").write_text(json.dumps({"opendb_id": "x", "metadata": {"name": "n"}}, indent=2))
    records, errors = read_open_db(spark, str(tmp_path))
    assert (records.count(), errors.count(), records.first().file_id) == (1, 0, "x")


def test_dry_run_counts_what_the_real_run_does_and_leaves_nothing(spark, three_waves):
    from gearledger.session import ensure_checkpoint_dir

    tables, _ = sync(spark, three_waves[:1], None, "2024-01-01")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = sorted(os.listdir(folder))
    found = dry_run(three_waves[1], tables, "2024-02-01")
    assert sorted(os.listdir(folder)) == before
    changed, outcomes = changes(three_waves[1], tables, "2024-02-01")
    done = {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    assert found == {"read": 3, "created": done["created"], "updated": done["updated"], **{n: t.count() for n, t in changed.as_dict().items()}}


def test_rows_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    """Rows that lie in one file go to as many tasks as their number asks for; repeated and null keys stay."""
    from pyspark.sql import functions as F

    from gearledger.catalogue_queries.shapes import spread

    rows = [(i % 50 if i % 7 else None,) for i in range(100)]
    spark.createDataFrame(rows, "k int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = spread(spark, str(tmp_path), "SELECT k FROM {part}", "part", "k", 10).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(map(str, (r.k for r in found))) == sorted(str(k) for k, in rows) and len({r.task for r in found}) > 4


PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_files_are_read_after_they_are_dealt(spark, tmp_path):
    """One file may hold all parts: no rule over the texts may run in the task that reads it, and curated rows are made in many tasks."""
    from gearledger.catalogue_queries.ingestion import curated, open_files
    from gearledger.plans.normalize import validate_open_db

    parts = spark.range(20_000).selectExpr("id", "concat('part ', id % 60)", "concat('Brand#', id % 25)", "'TYPE'", "cast(id % 50 + 1 as int)", "1.0D").toDF(
        *[c.split()[0] for c in PART.split(", ")])
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert curated(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    plan = validate_open_db(open_files(spark, str(tmp_path)))[0]._jdf.queryExecution().optimizedPlan().toString()
    before, dealing, after = plan.partition("RepartitionByExpression")
    assert dealing and "Filter" in before and "Filter" not in after


def test_waves_leave_what_they_change(spark, three_waves):
    """Four tables and the outcomes of each wave stay; a wave doesn't write again what the former left."""
    from pathlib import Path

    from gearledger.session import ensure_checkpoint_dir

    root = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    tables, outcomes = sync(spark, three_waves, None, "2024-01-01")
    assert len(set(root.iterdir()) - before) == 5 * len(three_waves)
    ids = [r.component_id for r in tables.components.select("component_id").collect()]
    assert len(ids) == len(set(ids)) == tables.components.count() and outcomes.filter("outcome = 'created'").count() == len(ids)


def test_a_record_that_comes_twice_in_a_wave(spark, three_waves):
    """The second feeds the component that the first founds; the search for components ends."""
    twice = three_waves[0].unionByName(three_waves[0])
    tables, outcomes = sync(spark, [twice], None, "2024-01-01")
    once, _ = sync(spark, [three_waves[0]], None, "2024-01-01")
    assert {r.component_id for r in tables.components.collect()} == {r.component_id for r in once.components.collect()}
    assert outcomes.count() == 2 * three_waves[0].count()
