"""Queries over chunks and contents of ``documents``: a class is a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import dedup as ops
from granary.plans.registry import once, query, table
from granary.store import numbered, stored

E = F.col
SIZE = 1024

# Texts by document, chunks of 1024 characters, and numbers of distinct chunks in order of first appearance.
CHUNKS = f"""pieces AS (SELECT doc_id, source AS class, unnest(range(0, (length(text) + {SIZE - 1}) // {SIZE}))::INTEGER AS pos, text FROM documents),
chunks AS (SELECT doc_id, class, pos, substr(text, pos * {SIZE} + 1, {SIZE}) AS content FROM pieces),
hashed AS (SELECT doc_id, class, pos, length(content) AS len, sha256(content) AS hash FROM chunks),
firsts AS (SELECT hash, len, row_number() OVER (ORDER BY min((doc_id, pos))) - 1 AS chunk FROM hashed GROUP BY hash, len)"""
BLOCKS = ", blocks AS (SELECT chunk // 16 AS block, min(chunk) AS first, count(*) AS n FROM firsts GROUP BY 1)"


def with_chunks(select: str, more: str = "") -> str:
    return f"WITH {CHUNKS}{more} {select}"


def contents(spark, d):
    return table(spark, d, "documents").select("doc_id", E("source").alias("class"), E("text").alias("content"))


def chunks(spark, d):
    return ops.fixed_chunks(contents(spark, d), SIZE, ("doc_id", "class"))


@once("chunk-table")
def chunk_table(spark, d):
    """Distinct chunks (hash, len) numbered by first appearance, with content-free rows."""
    return stored(numbered(ops.store(chunks(spark, d).select("hash", "len", "doc_id", "pos"), "doc_id", "pos"), "first", column="chunk"), "chunk-table")


def blocks(spark, d):
    return chunk_table(spark, d).groupBy((F.floor(E("chunk") / 16)).cast("long").alias("block")).agg(F.min("chunk").alias("first"), F.count("*").alias("n"))


def members(spark, d):
    return chunks(spark, d).join(chunk_table(spark, d).select("hash", "len", "chunk"), ["hash", "len"]).select(E("doc_id").alias("path"), "pos", "chunk")


@query("dom_fixed", with_chunks("SELECT doc_id, pos, len, hash FROM hashed"))
def _(spark, d):
    return chunks(spark, d).select("doc_id", "pos", "len", "hash")


@query("set_dedup", with_chunks("SELECT DISTINCT hash, len FROM hashed"))
def _(spark, d):
    return ops.distinct_chunks(chunks(spark, d))


@query("dom_dedup", with_chunks("SELECT chunk, hash, len FROM firsts"))
def _(spark, d):
    return chunk_table(spark, d).select("chunk", "hash", "len")


@query("src_chunk_point", with_chunks("SELECT chunk, hash, len FROM firsts WHERE chunk = 7"))
def _(spark, d):
    return chunk_table(spark, d).where("chunk = 7").select("chunk", "hash", "len")


@query("j_by_hash", with_chunks("SELECT hash, min(chunk) AS chunk FROM firsts GROUP BY hash"))
def _(spark, d):
    return ops.by_hash(chunk_table(spark, d))


KNOWN = ", new AS (SELECT doc_id * 1000 + pos AS ord, hash, len FROM hashed WHERE doc_id % 2 = 1), old AS (SELECT hash, len, min(doc_id * 1000 + pos) AS chunk FROM hashed WHERE doc_id % 2 = 0 GROUP BY ALL), seen AS (SELECT n.ord, n.hash, n.len, CASE WHEN o.chunk IS NOT NULL THEN 'old' WHEN min(n.ord) OVER (PARTITION BY n.hash, n.len) < n.ord THEN 'repeated' ELSE 'new' END AS state, coalesce(o.chunk, min(n.ord) OVER (PARTITION BY n.hash, n.len)) AS source FROM new n LEFT JOIN old o USING (hash, len))"


def judged(spark, d):
    rows = chunks(spark, d).select("doc_id", (E("doc_id") * 1000 + E("pos")).alias("ord"), "hash", "len")
    return ops.known(rows.where("doc_id % 2 = 1").drop("doc_id"), rows.where("doc_id % 2 = 0").withColumnRenamed("ord", "chunk"))


@query("j_known", with_chunks("SELECT ord, hash, len, state, source FROM seen", KNOWN))
def _(spark, d):
    return judged(spark, d)


@query("agg_writer", with_chunks("SELECT count(*) FILTER (WHERE state = 'new') AS written, count(*) FILTER (WHERE state = 'old') AS reused, count(*) FILTER (WHERE state = 'repeated') AS deduped, coalesce(sum(len) FILTER (WHERE state <> 'new'), 0)::BIGINT AS saved FROM seen", KNOWN))
def _(spark, d):
    return ops.writer_counts(judged(spark, d))


def savings_sql(by: str) -> str:
    label = "class" if by else "'(corpus)'"
    return f"""SELECT f.class, f.files, f.bytes::BIGINT AS bytes, f.files - f.u AS dup_files, (f.bytes - f.ub)::BIGINT AS dup_bytes, coalesce(c.chunks, 0) AS chunks, coalesce(c.u, 0) AS unique_chunks, coalesce(c.ub, 0)::BIGINT AS unique_chunk_bytes
 FROM (SELECT {label} AS class, count(*) AS files, sum(octet_length(encode(text))) AS bytes, count(DISTINCT text) AS u, (SELECT 0) AS z, sum(octet_length(encode(text))) FILTER (WHERE fst) AS ub
       FROM (SELECT source AS class, text, row_number() OVER (PARTITION BY {'source, ' if by else ''}text) = 1 AS fst FROM documents) GROUP BY {1 if by else "'x'"}) f
 LEFT JOIN (SELECT {label} AS class, sum(n)::BIGINT AS chunks, count(*) AS u, sum(len) AS ub FROM (SELECT {'class, ' if by else ''}hash, len, count(*) AS n FROM hashed GROUP BY ALL) GROUP BY {1 if by else "'x'"}) c USING (class)"""


def file_rows(spark, d):
    return contents(spark, d).select("class", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"))


@query("agg_dedup_class", with_chunks(savings_sql("class")))
def _(spark, d):
    return ops.savings(file_rows(spark, d), chunks(spark, d), corpus=False)


@query("agg_dedup_corpus", with_chunks(savings_sql("class") + " UNION ALL " + savings_sql("")))
def _(spark, d):
    return ops.savings(file_rows(spark, d), chunks(spark, d))


GROWTH = ", g AS (SELECT rank, count(*) AS new_chunks, sum(len)::BIGINT AS new_bytes FROM (SELECT hash, len, min(doc_id % 5) AS rank FROM hashed GROUP BY hash, len) GROUP BY rank)"


@query("agg_growth", with_chunks("SELECT rank, new_chunks, new_bytes, sum(new_chunks) OVER (ORDER BY rank)::BIGINT AS chunks, sum(new_bytes) OVER (ORDER BY rank)::BIGINT AS bytes FROM g", GROWTH))
def _(spark, d):
    return ops.growth(chunks(spark, d).withColumn("rank", E("doc_id") % 5))


@query("win_growth", with_chunks("SELECT rank, sum(new_bytes) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes FROM g", GROWTH))
def _(spark, d):
    return ops.growth(chunks(spark, d).withColumn("rank", E("doc_id") % 5)).select("rank", "bytes")


@query("win_first_seen", with_chunks("SELECT doc_id, pos, row_number() OVER (PARTITION BY hash ORDER BY doc_id, pos) = 1 AS first FROM hashed"))
def _(spark, d):
    return ops.first_seen(chunks(spark, d).select("doc_id", "pos", "hash"), "doc_id", "pos").select("doc_id", "pos", "first")


PLACED = BLOCKS + f""", spots AS (SELECT f.hash, f.len, f.chunk, b.block, coalesce(sum(f.len) OVER (PARTITION BY b.block ORDER BY f.chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS in_block FROM firsts f JOIN blocks b ON f.chunk >= b.first AND f.chunk < b.first + b.n),
placed AS (SELECT h.doc_id AS path, h.pos, s.chunk, s.block, s.in_block, coalesce(sum(h.len) OVER (PARTITION BY h.doc_id ORDER BY h.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS in_file, h.len FROM hashed h JOIN spots s USING (hash, len))"""


@query("j_place", with_chunks("SELECT path, pos, chunk, block, in_block, in_file, len FROM placed", PLACED))
def _(spark, d):
    return ops.places(members(spark, d), chunk_table(spark, d).select("chunk", "len"), blocks(spark, d))


@query("flt_range", with_chunks("SELECT path, pos, chunk FROM placed WHERE len > 0 AND in_file < 2500 AND in_file + len > 1000", PLACED))
def _(spark, d):
    placed = ops.places(members(spark, d), chunk_table(spark, d).select("chunk", "len"), blocks(spark, d))
    return ops.in_range(placed, 1000, 1500).select("path", "pos", "chunk")


@query("snk_extract", "SELECT doc_id AS path, sha256(text) AS digest, length(text) AS size FROM documents WHERE length(text) > 0")
def _(spark, d):
    from granary.sources.sinks import extract

    rows = chunks(spark, d)
    whole = extract(rows.select(E("doc_id").alias("path"), "pos", "hash"), rows.select("hash", "content").dropDuplicates(["hash"]))
    return whole.select("path", F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("size"))


@query("snk_archive", with_chunks("SELECT generation, (SELECT count(*) FROM documents WHERE doc_id % 2 < generation) AS files, (SELECT count(DISTINCT hash) FROM hashed WHERE doc_id % 2 < generation) AS blobs FROM (VALUES (1), (2)) g(generation)"))
def _(spark, d):
    from granary.sources import sinks
    from granary.store import fresh_path

    path, rows = fresh_path(spark, "container"), chunks(spark, d)
    for generation in (1, 2):
        mine = rows.where(E("doc_id") % 2 < generation)
        new = mine.select("hash", "content").dropDuplicates(["hash"])
        if generation > 1:
            new = new.join(sinks.read_container(spark, path)[2].select("hash"), "hash", "left_anti")
        docs = contents(spark, d).where(E("doc_id") % 2 < generation).select(E("doc_id").alias("path"), F.length("content").alias("size"))
        sinks.write_container(path, generation, docs, mine.select(E("doc_id").alias("path"), "pos", "hash"), new)
    out = None
    for generation in sinks.committed(spark, path):
        e, _, b = sinks.read_container(spark, path, generation)
        one = e.agg(F.count("*").alias("files")).crossJoin(b.agg(F.count("*").alias("blobs"))).select(F.lit(generation).alias("generation"), "files", "blobs")
        out = one if out is None else out.union(one)
    return out


@query("dom_verify", "SELECT doc_id || '#0' AS what, 'chunk missing' AS fault FROM documents WHERE doc_id = 11 UNION ALL SELECT doc_id::VARCHAR, 'size differs' FROM documents WHERE doc_id IN (11, 12)")
def _(spark, d):
    """Two faults are planted: the first chunk of a document is lost (its hash is its own), and a size is wrong."""
    rows = chunks(spark, d).withColumn("hash", F.when((E("doc_id") == 11) & (E("pos") == 0), F.lit("lost")).otherwise(E("hash")))
    docs = contents(spark, d).select(E("doc_id").cast("string").alias("path"), (F.length("content") + F.when(E("doc_id") == 12, 1).otherwise(0)).alias("size"))
    blobs = rows.where("hash <> 'lost'").select("hash", "content").dropDuplicates(["hash"])
    return ops.verify(docs, rows.select(E("doc_id").cast("string").alias("path"), "pos", "hash"), blobs)


RULES = f""", s AS ({savings_sql("class")} UNION ALL {savings_sql("")}),
planted AS (SELECT class, CASE WHEN class = '(corpus)' THEN files + 1 ELSE files END AS files, bytes, CASE WHEN class = 'src3' THEN files ELSE dup_files END AS dup_files, dup_bytes, chunks, unique_chunks, unique_chunk_bytes FROM s),
w AS (SELECT * FROM planted WHERE class = '(corpus)'), c AS (SELECT sum(files) AS files, sum(bytes) AS bytes, sum(dup_files) AS dup_files, sum(unique_chunks) AS unique_chunks, max(unique_chunks) AS most FROM planted WHERE class <> '(corpus)')
SELECT class, 'duplicates are fewer than files' AS rule FROM planted WHERE dup_files >= files AND files > 0 UNION ALL SELECT class, 'duplicate bytes are within bytes' FROM planted WHERE dup_bytes > bytes
UNION ALL SELECT class, 'distinct chunks are within chunks' FROM planted WHERE unique_chunks > chunks UNION ALL SELECT class, 'distinct bytes are within bytes' FROM planted WHERE unique_chunk_bytes > bytes
UNION ALL SELECT w.class, 'corpus files are the sum' FROM w, c WHERE w.files <> c.files UNION ALL SELECT w.class, 'corpus bytes are the sum' FROM w, c WHERE w.bytes <> c.bytes
UNION ALL SELECT w.class, 'corpus duplicates are at least the sum' FROM w, c WHERE w.dup_files < c.dup_files UNION ALL SELECT w.class, 'corpus chunks lie between most and sum' FROM w, c WHERE w.unique_chunks < c.most OR w.unique_chunks > c.unique_chunks"""


@query("dom_consistency", with_chunks("", RULES))
def _(spark, d):
    """Savings with two faults: a class that has duplicates only, and a file too many in the corpus row."""
    rows = ops.savings(file_rows(spark, d), chunks(spark, d)).withColumn("dup_files", F.when(E("class") == "src3", E("files")).otherwise(E("dup_files")))
    return ops.consistency(rows.withColumn("files", F.when(E("class") == "(corpus)", E("files") + 1).otherwise(E("files"))))


@query("dom_blocks")
def _(spark, d):
    rows = chunk_table(spark, d).select(F.concat(F.lit("c"), (E("chunk") % 4).cast("string")).alias("cluster"), "chunk", "len")
    return ops.pack_blocks(rows, 16 * SIZE)


@query("src_scan_private", "SELECT lang AS class, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes_total, sum(('0x' || substr(sha256(doc_id || chr(0) || octet_length(encode(text)) || chr(0) || sha256(text)), 1, 8))::BIGINT)::BIGINT AS digest FROM documents GROUP BY lang")
def _(spark, d):
    from granary.sources.walk import scan

    return scan(table(spark, d, "documents").select(E("doc_id").cast("string").alias("path"), E("text").alias("content"), "lang"), E("lang"))


SHARD_LENGTH, SHARD_GROUP = 64, 20
# Of each document's shards every sixteenth is damaged, and of some documents the frames are.
SHARDS = f"""s AS (SELECT doc_id, unnest(range(0, (octet_length(encode(text)) + {SHARD_LENGTH - 1}) // {SHARD_LENGTH})) AS n FROM documents),
g AS (SELECT doc_id, (n // {SHARD_GROUP})::INTEGER AS grp, count(*)::INTEGER AS shards, count(*) FILTER (WHERE n % 16 = 3) AS bad, doc_id % 10 <> 0 AS usable FROM s GROUP BY ALL)"""


def damaged_shards(spark, d):
    """Frames of the documents' shards, and the shards, with damage to both."""
    from granary.operators import recovery

    files = table(spark, d, "documents").select(E("doc_id").alias("path"), F.encode("text", "utf-8").alias("content"))
    shards = stored(recovery.shards_of(files, SHARD_LENGTH, SHARD_GROUP), "shards")
    frames = recovery.protect(shards, 10).withColumn("hash", F.when(E("path") % 10 == 0, "other").otherwise(E("hash")))
    hit = (E("grp") * SHARD_GROUP + E("shard")) % 16 == 3
    return stored(frames, "frames"), shards.withColumn("data", F.when(hit, F.concat("data", F.lit(b"!"))).otherwise(E("data")))


@query("dom_shard_scan", f"WITH {SHARDS} SELECT doc_id AS path, grp, usable, shards, CASE WHEN usable THEN bad ELSE 0 END AS damaged FROM g")
def _(spark, d):
    from granary.operators import recovery

    return recovery.scan(*damaged_shards(spark, d))


@query("dom_recovery", f"WITH {SHARDS}, r AS (SELECT doc_id, sum(shards) AS shards, sum(CASE WHEN usable AND bad <= greatest(1, (shards * 10 + 99) // 100) THEN bad ELSE 0 END) AS rebuilt, sum(CASE WHEN usable AND bad > greatest(1, (shards * 10 + 99) // 100) THEN bad ELSE 0 END) AS lost, sum(CASE WHEN usable THEN 0 ELSE shards END) AS unknown FROM g GROUP BY doc_id) SELECT r.doc_id AS path, shards::BIGINT AS shards, rebuilt::BIGINT AS rebuilt, lost::BIGINT AS lost, unknown::BIGINT AS unknown, CASE WHEN lost = 0 AND unknown = 0 THEN sha256(text) END AS digest FROM r JOIN documents d ON d.doc_id = r.doc_id")
def _(spark, d):
    """What is damaged is rebuilt, and whole documents have their texts' digests again."""
    from granary.operators import recovery

    mended = recovery.repair(*damaged_shards(spark, d))
    parts = F.array_sort(F.collect_list(F.struct("grp", "shard", "data")))
    whole = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["data"])), ""))
    state = lambda s: F.count_if(E("state") == s).alias(s)
    out = mended.groupBy("path").agg(F.count("*").alias("shards"), state("rebuilt"), state("lost"), state("unknown"), F.sha2(whole, 256).alias("digest"))
    return out.withColumn("digest", F.when((E("lost") == 0) & (E("unknown") == 0), E("digest")))


def zips(spark, d):
    """The folder of archives that the documents are packed to, and what was written."""
    from granary.sources.archives import write_zips
    from granary.store import fresh_path

    name, folder = F.concat(F.lit("part"), (E("doc_id") % 20).cast("string"), F.lit(".zip")), fresh_path(spark, "zips")
    docs = table(spark, d, "documents").select(name.alias("archive"), F.concat("lang", F.lit("/"), E("doc_id").cast("string")).alias("member"), F.encode("text", "utf-8").alias("content"))
    return folder, stored(write_zips(docs, folder), "zip-list")


@query("snk_export", "SELECT 'part' || (doc_id % 20) || '.zip' AS path, count(*) AS members FROM documents GROUP BY 1")
def _(spark, d):
    return zips(spark, d)[1].select("path", "members")


@query("src_foreign_read", "SELECT 'part' || (doc_id % 20) || '.zip' AS archive, lang || '/' || doc_id AS member, 'File' AS kind, octet_length(encode(text))::BIGINT AS size, sha256(text) AS digest FROM documents")
def _(spark, d):
    """Documents are packed to archives, whose files are read again."""
    from granary.sources.archives import read_archives

    files = spark.read.format("binaryFile").load(f"{zips(spark, d)[0]}/*.zip").select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    return read_archives(files, content=True).select("archive", "member", "kind", "size", F.sha2("content", 256).alias("digest"))


VOLUMES = "SELECT 'd' || doc_id % 50 || CASE doc_id % 4 WHEN 0 THEN '.7z.' || lpad((doc_id // 50 + 1)::VARCHAR, 3, '0') WHEN 1 THEN '.part' || (doc_id // 50 + 1) || '.rar' WHEN 2 THEN CASE WHEN doc_id < 50 THEN '.zip' ELSE '.z' || lpad((doc_id // 50)::VARCHAR, 2, '0') END ELSE CASE WHEN doc_id < 50 THEN '.RAR' ELSE '.r' || lpad((doc_id // 50 - 1)::VARCHAR, 2, '0') END END AS path, doc_id, doc_id % 50 AS stem, doc_id % 4 AS k, doc_id // 50 AS nth FROM documents WHERE doc_id // 50 < 90 AND doc_id % 37 <> 0"


@query("src_volumes", f"WITH v AS ({VOLUMES}), n AS (SELECT *, CASE WHEN k = 2 AND nth = 0 THEN 1000 ELSE nth END AS place FROM v), s AS (SELECT stem, k, count(*) AS n, min(nth) AS low, max(nth) AS high FROM n GROUP BY stem, k) SELECT n.path, row_number() OVER (PARTITION BY n.stem, n.k ORDER BY place) AS volume, CASE WHEN s.k = 2 THEN s.low = 0 AND s.high = s.n - 1 ELSE s.low = 0 AND s.high = s.n - 1 END AS complete FROM n JOIN s ON s.stem = n.stem AND s.k = n.k WHERE s.n > 1")
def _(spark, d):
    """Volumes of sets in four ways of naming; some are missing."""
    from granary.sources.archives import volume_sets

    docs, nth = table(spark, d, "documents").where("doc_id < 4500 and doc_id % 37 <> 0"), F.floor(E("doc_id") / 50)
    padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
    name = (
        F.when(E("doc_id") % 4 == 0, F.concat(F.lit(".7z."), padded(nth + 1, 3)))
        .when(E("doc_id") % 4 == 1, F.concat(F.lit(".part"), (nth + 1).cast("string"), F.lit(".rar")))
        .when(E("doc_id") % 4 == 2, F.when(nth == 0, ".zip").otherwise(F.concat(F.lit(".z"), padded(nth, 2))))
        .otherwise(F.when(nth == 0, ".RAR").otherwise(F.concat(F.lit(".r"), padded(nth - 1, 2))))
    )
    files = docs.select(F.concat(F.lit("d"), (E("doc_id") % 50).cast("string"), name).alias("path"))
    return volume_sets(files).select("path", F.col("volume").cast("long").alias("volume"), "complete")
