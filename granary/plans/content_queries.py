"""Queries over the bytes of files: classes, formats, statistics, embedded text, content-defined chunks, codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import content, kinds
from granary.plans.registry import query, table

E = F.col

#: Files over ``documents``, by doc_id modulo their number: zero bytes, bytes in hex, then the text ("noise": hashes of the
#: text alone), and what stands before and after the id in the path.
SAMPLES = [
    (0, "FFD8FFE0", "p/", ".jpg"), (0, "FFD8FF", "p/", ".txt"), (0, "89504E470D0A1A0A", "p/", ".PNG"), (0, "504B0304", "p/", ".docx"), (0, "504B0304", "p/", ".pth"),
    (0, "504B0506", "p/", ".epub"), (0, "1F8B08", "p/", ".tgz"), (0, "1F8B07", "p/", ".log"), (0, "255044462D312E37", "p/", ""), (0, "7F454C46", "p/", ".so"),
    (0, "CAFEBABE00000002", "p/", ".dylib"), (0, "CAFEBABE00000034", "p/", ".class"), (0, "4D5A9000", "p/", ".exe"), (0, "4D5A", "p/", ".md"), (0, "49443303000000000A10", "p/", ".mp3"),
    (0, "4944330900", "p/", ".mp3"), (0, "524946460000000057415645", "p/", ".wav"), (0, "524946460000000057454250", "p/", ".webp"), (0, "5249464600000000415649202E", "p/", ".x"),
    (0, "0000001866747970", "p/", ".mp4"), (0, "00000018667479704D344120", "p/", ".m4a"), (0, "000000186674797068656963", "p/", ".mov"), (0, "000000186674797063727820", "p/", ".cr3"),
    (0, "425A6839314159265359", "p/", ".bz2"), (0, "425A6830", "p/", ".bz2"), (0, "424D0000000100000000FF00FFFF", "p/", ".bmp"), (0, "50360A23", "p/", ".ppm"), (0, "FFFB9064", "p/", ".mp3"),
    (32769, "4344303031", "p/", ".iso"), (257, "7573746172", "p/", ".bin"), (0, "47", "p/", ".ts"), (0, "00", "p/", ".csv"), (0, "010203040506070801", "p/", ".yaml"),
    (0, "1A45DFA3", "p/", ".mka"), (0, "47475546", "p/", ".bin"), (0, "D0CF11E0A1B11AE1", "p/", ".msi"), (0, "303730373031", "p/", ".cpio"), (0, "213C617263683E0A", "p/", ".lib"),
    (0, "28B52FFD", "p/", ".zst"), (0, "23206D6F64656C0A0A762030203020310A", "p/", ".obj"), (0, "4C0103", "p/", ".obj"), (0, "", "p/", ".md"), (0, "", "src/", ".RS"), (0, "", "d/", ".ndjson"),
    (0, "", "d/", ".cmake"), (0, "", "d/", ".unknown"), (0, "", "d/.", ""), (0, "", "x/", "/.GitIgnore"), (0, "", "x/.GIT/", ".jpg"), (0, "", "x.git/", ".jpg"), (0, "626567696E20363434206E616D650A", "d/", ".uue"),
    (0, "noise", "n/", ".bin"),
]
VALUES = ", ".join(f"({k}, {pad}, '{raw}', '{before}', '{after}')" for k, (pad, raw, before, after) in enumerate(SAMPLES))
FILES = f"""samples(k, pad, raw, before, after) AS (VALUES {VALUES}),
noisy AS (SELECT doc_id, unhex(string_agg(sha256(text || i), '' ORDER BY i)) AS content FROM (SELECT doc_id, text, unnest(range(1, 2049)) AS i FROM documents WHERE doc_id % {len(SAMPLES)} = {len(SAMPLES) - 1}) GROUP BY doc_id),
f AS (SELECT d.doc_id, before || d.doc_id || after AS path, CASE WHEN raw = 'noise' THEN n.content ELSE unhex(repeat('00', pad) || replace(raw, 'noise', '')) || encode(text) END AS content
  FROM documents d JOIN samples ON k = d.doc_id % {len(SAMPLES)} LEFT JOIN noisy n ON n.doc_id = d.doc_id),
names AS (SELECT *, split_part(path, '/', -1) AS name, hex(content) AS h FROM f),
named AS (SELECT *, CASE WHEN strpos(substr(name, 2), '.') > 0 THEN lower(split_part(name, '.', -1)) ELSE '' END AS ext FROM names)"""


def with_files(select: str, more: str = "") -> str:
    return f"WITH {FILES}{more} {select}"


def sample_files(spark, d):
    """doc_id, path and content of the files that :data:`SAMPLES` makes of documents."""
    made = spark.createDataFrame([(k, *s) for k, s in enumerate(SAMPLES)], "k int, pad int, raw string, before string, after string")
    docs = table(spark, d, "documents").select("doc_id", "text", (E("doc_id") % len(SAMPLES)).cast("int").alias("k"))
    noise = F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2048)), lambda i: F.sha2(F.concat("text", i.cast("string")), 256)), ""))
    body = F.when(E("raw") == "noise", noise).otherwise(F.concat(F.unhex(F.repeat(F.lit("00"), E("pad"))), F.coalesce(F.unhex(F.nullif("raw", F.lit("noise"))), F.lit(b"")), F.encode("text", "utf-8")))
    return docs.join(F.broadcast(made), "k").select("doc_id", F.concat("before", E("doc_id").cast("string"), "after").alias("path"), body.alias("content"))


# ---- classes


def pairs(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case(rows) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {then}" for test, then in rows)


CLASS = (
    case(
        [("h = ''", "'other'")]
        + [(f"h LIKE '{magic.hex().upper()}%'", f"'{name}'") for name, magic in content.MAGIC]
        + [
            ("h LIKE '494433%' AND regexp_matches(h, '^4944330[2-4]([0-9A-E].|F[0-E])..([0-7].){4}')", "'audio'"),
            ("regexp_matches(h, '^CAFEBABE000000[01]')", "'executable'"),
            ("h LIKE 'CAFEBABE%'", "'other'"),
            ("regexp_matches(h, '^52494646.{8}57415645')", "'audio'"),
            ("regexp_matches(h, '^52494646.{8}41564920')", "'video'"),
            ("regexp_matches(h, '^52494646.{8}57454250')", "'compressed'"),
            ("regexp_matches(h, '^.{8}667479704D344120')", "'audio'"),
            ("regexp_matches(h, '^.{8}66747970(61766966|68656963|6D696631)')", "'compressed'"),
            ("regexp_matches(h, '^.{8}66747970.{8}')", "'video'"),
            ("regexp_matches(h, '^425A683[1-9]')", "'compressed'"),
            ("regexp_matches(h, '^424D.{8}00000000.{8}')", "'image-raw'"),
            ("regexp_matches(h, '^503[1-6](20|09|0A|0D)(3[0-9]|23)')", "'image-raw'"),
            ("h LIKE 'FFFB90%' AND octet_length(content) < 417 + 4", "'audio'"),  # a frame of 417 bytes that none follows
            # Text holds valid UTF-8; what is put before it is ASCII or not valid.
            ("NOT noisy AND regexp_matches(raw, '^([0-7].)*$') AND pad = 0 AND list_count(list_filter(bytes, lambda x: x = '00')) = 0 AND len(list_filter(bytes, lambda x: x < '09' OR x BETWEEN '0E' AND '1F' OR x = '7F')) < 0.005 * len(bytes)", "'text'"),
        ]
    )
    + " ELSE CASE WHEN noisy THEN 'high-entropy' ELSE 'other' END END"
)
CLASSED = f""", sampled AS (SELECT n.*, s.raw, s.pad, s.raw = 'noise' AS noisy, regexp_extract_all(substr(h, 1, 131072), '..') AS bytes FROM named n JOIN samples s ON s.k = n.doc_id % {len(SAMPLES)}),
classed AS (SELECT doc_id, path, octet_length(content) AS size, ext, {CLASS} AS class FROM sampled)"""
KIND = f"CASE WHEN ext IN ({pairs(kinds.SOURCE)}) THEN 'source' WHEN ext IN ({pairs(kinds.STRUCTURED)}) THEN 'structured' ELSE 'prose' END"


@query("fn_classify", with_files("SELECT doc_id, class FROM classed", CLASSED))
def _(spark, d):
    return sample_files(spark, d).select("doc_id", content.classify("content").alias("class"))


@query("fn_text_kind", with_files(f"SELECT doc_id, {KIND} AS kind FROM named"))
def _(spark, d):
    return sample_files(spark, d).select("doc_id", kinds.text_kind(E("path")).alias("kind"))


PLACES = case((f"cluster = '{label}'", i) for i, label in enumerate(kinds.ORDER)) + f" ELSE {len(kinds.ORDER)} END"
CLUSTERED = CLASSED + f", clustered AS (SELECT *, CASE WHEN class = 'text' THEN 'text/' || {KIND} ELSE class END AS cluster FROM classed)"


@query("dom_cluster", with_files("SELECT cluster, count(*) AS files, sum(size)::BIGINT AS bytes FROM clustered GROUP BY cluster", CLUSTERED))
def _(spark, d):
    """Files by what their content, and for text their name, makes them."""
    files = sample_files(spark, d).select("path", F.octet_length("content").cast("long").alias("size"), content.classify("content").alias("class"))
    return files.groupBy(kinds.cluster(E("class"), E("path")).alias("cluster")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("srt_cluster", with_files(f"SELECT doc_id, {PLACES} AS rank, row_number() OVER (ORDER BY {PLACES}, path) - 1 AS pos FROM clustered", CLUSTERED))
def _(spark, d):
    """Files in the order in which they are written: by cluster, and in it by path."""
    from granary.store import numbered

    files = sample_files(spark, d).select("doc_id", "path", kinds.cluster_rank(kinds.cluster(content.classify("content"), E("path"))).alias("rank"))
    return numbered(files, "rank", "path", column="pos").select("doc_id", "rank", "pos")


@query("flt_class_store", with_files("SELECT doc_id, class FROM classed WHERE class IN ('high-entropy', 'video', 'compressed', 'jpeg', 'png')", CLASSED))
def _(spark, d):
    """Files whose class is stored as it is."""
    return sample_files(spark, d).select("doc_id", content.classify("content").alias("class")).where(E("class").isin(content.STORED))


def corpus_sql() -> str:
    rows = [("regexp_matches(path, '(?i)(^|/)\\.git/')", "'source-git'")]
    for s in kinds.SIGNATURES:
        test = " AND ".join(f"substr(h, {2 * at + 1}, {2 * len(magic)}) = '{magic.hex().upper()}'" for at, magic in s.checks)
        test += f" AND ext IN ({pairs(s.only)})" if s.only else ""
        rows += [(f"{test} AND ext IN ({pairs(extensions)})", f"'{kind}'") for extensions, kind in s.refined] + [(test, f"'{s.kind}'")]
    rows.append((f"lower(name) IN ({pairs(kinds.GIT_NAMES)})", "'source-git'"))
    # Of the samples with this extension one begins as a model does, the other not.
    rows += [("ext = 'obj' AND h LIKE '23206D6F64656C0A0A7620%' AND regexp_matches(substr(h, 1, 2048), '^(0[1-9A-F]|[1-7].)*$')", "'game-assets'"), ("ext = 'obj'", "'software-installed'")]
    rows += [(f"ext IN ({pairs(extensions.split())})", f"'{kind}'") for kind, extensions in kinds.EXTENSIONS]
    return with_files(f"SELECT doc_id, {case(rows)} ELSE 'other' END AS class FROM named")


@query("fn_corpus_class", corpus_sql())
def _(spark, d):
    return sample_files(spark, d).select("doc_id", kinds.corpus_class(E("path"), F.substring("content", 1, kinds.HEAD)).alias("class"))


FORMAT = case(
    [
        ("h LIKE '377ABCAF271C%'", "'7z'"), ("regexp_matches(h, '^526172211A07(00|0100)')", "'rar'"), ("regexp_matches(h, '^504B(0304|0506|0708504B0304)')", "'zip'"), ("h LIKE '1F8B08%'", "'gzip'"),
        ("regexp_matches(h, '^425A683[1-9](314159265359|177245385090)')", "'bzip2'"), ("h LIKE 'FD377A585A00%'", "'xz'"), ("h LIKE '28B52FFD%'", "'zstd'"), ("h LIKE '213C617263683E0A%'", "'ar'"),
        ("regexp_matches(h, '^30373037303[127]')", "'cpio'"), ("substr(h, 515, 10) = '7573746172'", "'tar'"), ("regexp_matches(substr(h, 1, 131072), '(^|0A)626567696E20(3[0-7]){3,4}20')", "'uue'"),
        ("substr(h, 65539, 10) = '4344303031'", "'iso'"),
    ]
) + " END"


@query("src_foreign_detect", with_files(f"SELECT doc_id, {FORMAT} AS format FROM named"))
def _(spark, d):
    return sample_files(spark, d).select("doc_id", content.container_format("content").alias("format"))


# ---- statistics


def raw(spark, d):
    return table(spark, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))


BYTES = "b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte, unnest(range(0, octet_length(encode(text)))) AS pos FROM documents)"


def entropy_sql(where: str = "true") -> str:
    return f"SELECT doc_id, -sum(n / total * log2(n / total)) AS bits FROM (SELECT doc_id, byte, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM b WHERE {where} GROUP BY doc_id, byte) GROUP BY doc_id"


ENTROPIES = f"WITH {BYTES}, e AS ({entropy_sql()}), s AS ({entropy_sql(f'pos % {content.STRIDE} < {content.HEAD}')})"


@query("fn_entropy", f"{ENTROPIES} SELECT doc_id, round(bits, 6) AS entropy FROM e")
def _(spark, d):
    return raw(spark, d).select("doc_id", F.round(content.entropy("content"), 6).alias("entropy"))


@query("fn_entropy_sampled", f"{ENTROPIES} SELECT doc_id, round(bits, 6) AS entropy FROM s")
def _(spark, d):
    return raw(spark, d).select("doc_id", F.round(content.entropy_sampled("content"), 6).alias("entropy"))


@query("fn_incompressible", with_files("SELECT doc_id, raw = 'noise' AS incompressible FROM sampled", CLASSED))
def _(spark, d):
    """Noise is, text behind any head isn't."""
    return sample_files(spark, d).select("doc_id", content.incompressible("content").alias("incompressible"))


SHARE = "round(count(*) FILTER (WHERE {}) / count(*), 9)"


@query("fn_features", f"""WITH {BYTES}, e AS ({entropy_sql()}), m AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY ALL) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS len, {SHARE.format("byte BETWEEN '20' AND '7E' OR byte IN ('09', '0A', '0D')")} AS printable, {SHARE.format("byte = '00'")} AS nul,
  {SHARE.format("byte < '09' OR byte BETWEEN '0E' AND '1F' OR byte = '7F'")} AS control, {SHARE.format("byte = '0A'")} AS newline FROM b GROUP BY doc_id)
SELECT doc_id, len, round(bits, 6) AS entropy, printable, nul, control, newline, true AS utf8, round(m.n / len, 9) AS max_byte FROM g JOIN e USING (doc_id) JOIN m USING (doc_id)""")
def _(spark, d):
    found = raw(spark, d).withColumn("f", content.features("content")).select("doc_id", "f.*")
    return found.withColumns({"entropy": F.round("entropy", 6)} | {c: F.round(c, 9) for c in ("printable", "nul", "control", "newline", "max_byte")})


# ---- embedded text (held against plain Python in the tests)


@query("fn_base64")
def _(spark, d):
    packed = F.concat(F.lit("x: "), F.base64(F.encode(F.concat("text", F.lit(" "), "text"), "utf-8")), F.lit(" !"))
    return table(spark, d, "documents").select("doc_id", content.base64_spans(F.encode(packed, "utf-8")).alias("runs"))


@query("fn_utf16")
def _(spark, d):
    """Texts as UTF-16 in either byte order, and the runs of such text inside other bytes."""
    order = F.when(E("doc_id") % 2 == 0, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    inside = F.concat(F.lit(b"\x07\x01\x02"), F.encode("text", "UTF-16LE"), F.lit(b"\xff\x01\x03"))
    return table(spark, d, "documents").select("doc_id", content.utf16(order).alias("u"), content.utf16_spans(inside).alias("runs")).select("doc_id", "u.kind", "u.exact", F.octet_length("u.text").alias("bytes"), "runs")


# ---- chunks and codecs (likewise)


@query("dom_cdc")
def _(spark, d):
    return content.cdc_chunks(raw(spark, d), (256, 1024, 8192), key="doc_id")


@query("dom_trial")
def _(spark, d):
    return raw(spark, d).withColumn("t", content.trial("content")).select("doc_id", "t.*")


@query("dom_delta")
def _(spark, d):
    twin = raw(spark, d).select((E("doc_id") + 1).alias("doc_id"), E("content").alias("old"))
    return raw(spark, d).join(twin, "doc_id").withColumn("x", content.delta("old", "content")).select("doc_id", "x.*")


CHAINS = ["store", "zstd", "lzma", "bwt+zstd", "x86", "arm", "delta+zstd", "delta4", "png+lzma", "base64", "utf16+lzma", "utf16+bwt+zstd"]


@query("dom_codecs", "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS size FROM documents")
def _(spark, d):
    """Every document through a chain of primitives and back: as text, or as base64 or UTF-16 where the chain is for that."""
    from granary.functions import codecs

    chain = F.element_at(F.array(*[F.lit(c) for c in CHAINS]), (E("doc_id") % len(CHAINS) + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", chain.alias("chain"), "text")
    given = F.when(E("chain") == "base64", F.encode(F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", ""), "utf-8")).when(E("chain").startswith("utf16"), F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "utf-8"))
    back = docs.withColumn("back", codecs.decoded(codecs.encoded(given, "chain"), "chain"))
    text = F.when(E("chain") == "base64", F.unbase64(E("back").cast("string")).cast("string")).when(E("chain").startswith("utf16"), F.decode("back", "UTF-16LE")).otherwise(E("back").cast("string"))
    return back.select("doc_id", F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("size"))
