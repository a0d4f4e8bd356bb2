"""All queries of the block store by name, with equivalent DuckDB SQL where SQL can express them.

Rows of the driver's tables stand in for files: a document is an entry whose content is its text, an order's line items are
alternative representations of one block, and conversations are entries of several chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import chunking, codecs, scalars
from cairn.operators import dedup, frontier, lattice
from cairn.plans import bridge, store
from cairn.sources import archive
from cairn.streaming import incremental

SIZES = {"least": 64, "target": 256, "most": 1024}
DOC_PATH = "concat_ws('/', 'documents', lang, concat(cast(doc_id as string), '.txt'))"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", "lang", F.expr(DOC_PATH).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.refs(chunking.chunk(chunking.spread(_docs(spark, d)), **SIZES))


_P = "concat_ws('/', 'documents', lang, doc_id || '.txt')"
#: Chunks (path, lang, seq, s, e, n, block_hash) of all documents, from the definition of the rolling hash.
_CHUNKS = (
    """WITH RECURSIVE gear AS (SELECT i, ('0x'||substr(sha256('QBX-GEAR-'||i),12,5))::BIGINT % 256 g FROM range(256) t(i)),
doc AS (SELECT doc_id, hex(encode(coalesce(text,''))) hx, octet_length(encode(coalesce(text,''))) n FROM documents),
byt AS (SELECT doc_id, n, unnest(range(1,n+1)) p, hx FROM doc),
gb AS (SELECT doc_id, p, g FROM byt JOIN gear ON i = ('0x'||substr(hx,2*p-1,2))::BIGINT),
cand AS (SELECT doc_id, p FROM (SELECT doc_id, p, (g"""
    + "".join(f" + coalesce(lag(g,{k}) OVER w,0)*{1 << k}" for k in range(1, 8))
    + f""") % 256 h FROM gb WINDOW w AS (PARTITION BY doc_id ORDER BY p)) WHERE h = 0),
cl AS (SELECT doc_id, n, coalesce(list(p ORDER BY p) FILTER (p IS NOT NULL),[]) ps FROM doc LEFT JOIN cand USING (doc_id) GROUP BY doc_id, n),
walk(doc_id,n,ps,seq,s,e) AS (
 SELECT doc_id,n,ps,0,0::BIGINT, least(coalesce(list_min(list_filter(ps, lambda x: x>=64)),n),1024,n) FROM cl WHERE n>0
 UNION ALL SELECT doc_id,n,ps,seq+1,e, least(coalesce(list_min(list_filter(ps, lambda x: x>=e+64)),n),e+1024,n) FROM walk WHERE e<n),
chunks AS (SELECT {_P} AS path, lang, seq, s, e, e-s AS size, sha256(unhex(substr(hx, 2*s+1, 2*(e-s)))) AS block_hash
 FROM walk JOIN doc USING (doc_id) JOIN documents USING (doc_id)) """
)


# Deduplication


@_query(f"SELECT {_P} AS path, octet_length(encode(coalesce(text,'')))::BIGINT AS size, sha256(coalesce(text,'')) AS sha256 FROM documents")
def entry_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


@_query(_CHUNKS + "SELECT path, seq::INT AS seq, s::BIGINT AS start, e::BIGINT AS stop, block_hash FROM chunks")
def chunk_refs(spark: SparkSession, d: str) -> DataFrame:
    return _refs(spark, d).select("path", "seq", "start", "stop", "block_hash")


@_query(_CHUNKS + "SELECT block_hash, count(*)::BIGINT AS n_refs, max(size)::INT AS raw_size, min(path || '#' || lpad(seq::VARCHAR, 6, '0')) AS first_ref FROM chunks GROUP BY 1")
def dedup_blocks(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat("path", F.lit("#"), F.lpad(F.col("seq").cast("string"), 6, "0"))
    return _refs(spark, d).groupBy("block_hash").agg(F.count("*").alias("n_refs"), F.max(F.length("raw")).alias("raw_size"), F.min(ref).alias("first_ref"))


_STATS = "sum(n)::BIGINT AS n_refs, count(*)::BIGINT AS unique_blocks, sum(n*size)::BIGINT AS total_bytes, sum(size)::BIGINT AS unique_bytes, sum((n-1)*size)::BIGINT AS saved_bytes"


@_query(_CHUNKS + f"SELECT {_STATS} FROM (SELECT block_hash, count(*) n, max(size) size FROM chunks GROUP BY 1)")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.stats(_refs(spark, d), [])


@_query(_CHUNKS + f"SELECT lang, {_STATS} FROM (SELECT lang, block_hash, count(*) n, max(size) size FROM chunks GROUP BY 1, 2) GROUP BY 1")
def dedup_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    steps = F.split("path", "/")
    return dedup.stats(_refs(spark, d).withColumn("lang", F.when(F.size(steps) == 3, steps[1])), ["lang"])


@_query(f"SELECT sha256(coalesce(text,'')) AS sha256, count(*)::BIGINT AS n, min({_P}) AS first_path FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_entries(spark: SparkSession, d: str) -> DataFrame:
    hashed = _docs(spark, d).groupBy(F.sha2("content", 256).alias("sha256"))
    return hashed.agg(F.count("*").alias("n"), F.min("path").alias("first_path")).filter("n > 1")


# Reassembly and integrity


@_query("SELECT conv_id, sha256(string_agg(coalesce(text,''), '' ORDER BY turn, text)) AS sha256, sum(octet_length(encode(coalesce(text,''))))::BIGINT AS size FROM conversations GROUP BY 1")
def entry_reassembly_hash(spark: SparkSession, d: str) -> DataFrame:
    raw = F.coalesce("text", F.lit("")).cast("binary")
    turns = _read(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))
    whole = F.array_sort(F.collect_list(F.struct("turn", "raw")))
    joined = F.aggregate(whole, F.lit(b""), lambda a, x: F.concat(a, x["raw"]))
    return turns.groupBy("conv_id").agg(F.sha2(joined, 256).alias("sha256"), F.sum(F.length("raw")).cast("long").alias("size"))


_MASK = "doc_id % 5 = 0"


@_query(f"SELECT count(*)::BIGINT AS n_blocks, count_if({_MASK})::BIGINT AS damaged, count_if(NOT ({_MASK}))::BIGINT AS intact, bool_and(NOT ({_MASK})) AS healthy FROM documents")
def integrity_counts(spark: SparkSession, d: str) -> DataFrame:
    stored = _docs(spark, d).withColumn("hash", F.sha2("content", 256)).withColumn("now", F.when(F.expr(_MASK), F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    bad = archive.status(F.col("now"), F.col("hash")) != "ok"
    return stored.agg(F.count("*").alias("n_blocks"), F.count_if(bad).alias("damaged"), F.count_if(~bad).alias("intact"), F.every(~bad).alias("healthy"))


@_query(f"WITH r AS (SELECT doc_id, sha256(coalesce(text,'')) h FROM documents), b AS (SELECT DISTINCT h FROM r WHERE NOT ({_MASK})) SELECT doc_id, h AS block_hash FROM r WHERE h NOT IN (SELECT h FROM b)")
def missing_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = _docs(spark, d).select("doc_id", F.sha2("content", 256).alias("block_hash"))
    return refs.join(refs.filter(f"not ({_MASK})").select("block_hash"), "block_hash", "left_anti").select("doc_id", "block_hash")


_SAFE_SQL = """NOT (p IS NULL OR p = '' OR contains(p, chr(0)) OR contains(p, '\\') OR starts_with(p, '/') OR len(list_filter(string_split(p,'/'), lambda x: x NOT IN ('','.'))) = 0
 OR list_contains(string_split(p,'/'), '..') OR contains(coalesce(list_filter(string_split(p,'/'), lambda x: x NOT IN ('','.'))[1], ''), ':'))"""


@_query(f"WITH e AS (SELECT url AS p, page_id FROM pages) SELECT 'unsafe path' AS rule, p AS path FROM e WHERE NOT ({_SAFE_SQL}) UNION ALL SELECT 'path stands twice', p FROM e GROUP BY p HAVING count(*) > 1")
def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    pages = _read(spark, d, "pages").select(F.col("url").alias("path"), F.lit(1).alias("size"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
    return archive.manifest_violations(pages)


@_query(f"SELECT sha256(string_agg({_P} || coalesce(text,''), '' ORDER BY {_P}, coalesce(text,''))) AS tree_hash FROM documents")
def tree_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash over the whole tree: SHA-256 isn't mergeable, so one task reads everything, as in the definition, row by row."""
    return dedup.tree_hash(_docs(spark, d))


# Choice among representations, over line items

_GOALS = ["l_quantity", "l_extendedprice", "l_tax"]
_PARETO = """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem c WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = c.l_orderkey
 AND d.l_quantity <= c.l_quantity AND d.l_extendedprice <= c.l_extendedprice AND d.l_tax <= c.l_tax AND (d.l_quantity < c.l_quantity OR d.l_extendedprice < c.l_extendedprice OR d.l_tax < c.l_tax))"""


@_query(_PARETO)
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    return frontier.pareto(_read(spark, d, "lineitem"), "l_orderkey", _GOALS, ["l_orderkey", "l_linenumber", *_GOALS])


@_query(f"SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_quantity, l_extendedprice, l_tax, l_linenumber) AS frontier FROM ({_PARETO}) GROUP BY 1")
def frontier_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*_GOALS, "l_linenumber")))
    return pareto_frontier(spark, d).groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["l_linenumber"].cast("string")), ",").alias("frontier"))


_LOCAL = "SELECT l_orderkey, m.q AS l_quantity, m.p AS l_extendedprice, m.t AS l_tax, m.l AS l_linenumber FROM (SELECT l_orderkey, min({'q': l_quantity, 'p': l_extendedprice, 't': l_tax, 'l': l_linenumber}) m FROM lineitem GROUP BY 1)"


@_query(_LOCAL)
def local_smallest(spark: SparkSession, d: str) -> DataFrame:
    return frontier.local_best(_read(spark, d, "lineitem"), "l_orderkey", [*_GOALS, "l_linenumber"])


@_query(f"SELECT round(sum(l_quantity), 2) AS stored, round(sum(l_extendedprice), 2) AS encode, round(sum(l_tax), 2) AS decode, count(*)::BIGINT AS n FROM ({_LOCAL})")
def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    total = lambda c, n: F.round(F.sum(c), 2).alias(n)
    return local_smallest(spark, d).agg(total("l_quantity", "stored"), total("l_extendedprice", "encode"), total("l_tax", "decode"), F.count("*").alias("n"))


_NORM = "SELECT greatest(sum(r),1) AS raw_total, greatest(sum(e),1) AS encode_total, greatest(sum(t),1) AS decode_total FROM (SELECT l_orderkey, max(l_quantity) r, max(l_extendedprice) e, max(l_tax) t FROM lineitem GROUP BY 1)"


@_query(f"SELECT round(raw_total, 2) AS raw_total, round(encode_total, 2) AS encode_total, round(decode_total, 2) AS decode_total FROM ({_NORM})")
def plan_normalisers(spark: SparkSession, d: str) -> DataFrame:
    rows = frontier.normalisers(_read(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice", "l_tax")
    return rows.select(*[F.round(c, 2).alias(c) for c in rows.columns])


@_query(f"SELECT l_orderkey, l_linenumber, round((0.50*l_quantity/raw_total + 0.20*l_extendedprice/encode_total + 0.30*l_tax/decode_total)*1e6, 4) AS cost FROM lineitem, ({_NORM})")
def weighted_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "lineitem")
    totals = frontier.normalisers(rows, "l_orderkey", "l_quantity", "l_extendedprice", "l_tax")
    out = frontier.weighted(rows, totals, "l_quantity", "l_extendedprice", "l_tax")
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("cost") * 1e6, 4).alias("cost"))


def _strategies(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("ord"), F.col("l_extendedprice").alias("size"), F.col("l_quantity").alias("decode_ms"), (F.col("l_tax") * 100).alias("memory_mb")
    )


@_query("SELECT l_orderkey AS group_id, m.l AS ord, round(m.o, 2) AS objective FROM (SELECT l_orderkey, min({'o': 1.0*l_extendedprice + 2.0*l_quantity + 0.0*(l_tax*100), 'l': l_linenumber}) FILTER (l_quantity <= 40 AND l_tax*100 <= 7) m FROM lineitem GROUP BY 1)")
def classical_plan(spark: SparkSession, d: str) -> DataFrame:
    out = frontier.classical_plan(_strategies(spark, d), time=2.0, max_decode_ms=40, max_memory_mb=7)
    return out.withColumn("objective", F.round("objective", 2))


@_query("SELECT l_orderkey AS block_hash, CASE WHEN m.s >= r - 16 THEN 0 ELSE m.l END AS codec, CASE WHEN m.s >= r - 16 THEN r ELSE m.s END AS stored_size FROM (SELECT l_orderkey, min({'s': l_partkey, 'l': l_linenumber}) m, max(l_partkey) r FROM lineitem GROUP BY 1)")
def choose_with_raw_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_hash"), F.col("l_linenumber").alias("codec"), F.col("l_partkey").alias("stored_size"), F.col("l_partkey").alias("raw_size"))
    return codecs.choose(rows)


@_query("SELECT concat_ws(':', l_returnflag, CASE WHEN l_linenumber > 1 THEN l_linenumber END) AS label, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def codec_histogram(spark: SparkSession, d: str) -> DataFrame:
    label = scalars.codec_label(F.col("l_returnflag"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")))
    return _read(spark, d, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@_query()
def codec_candidates(spark: SparkSession, d: str) -> DataFrame:
    blocks = _docs(spark, d).select(F.sha2("content", 256).alias("block_hash"), F.col("content").alias("raw")).dropDuplicates(["block_hash"])
    return codecs.candidates(blocks).select("block_hash", "cand_idx", "name", "level", "raw_size", "stored_size")


@_query("SELECT sha256(coalesce(text,'')) AS block_hash, 10::BIGINT AS n, 10::BIGINT AS intact FROM documents GROUP BY 1")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    blocks = _docs(spark, d).select(F.sha2("content", 256).alias("block_hash"), F.col("content").alias("raw")).dropDuplicates(["block_hash"])
    back = codecs.candidates(blocks).withColumn("d", codecs.decoded("codec", "payload", "raw_size"))
    return back.groupBy("block_hash").agg(F.count("*").alias("n"), F.count_if(F.sha2("d.raw", 256) == F.col("block_hash")).alias("intact"))


# Small planners


def _costs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("cost"))


_QUBO = "WITH c AS (SELECT l_orderkey g, l_linenumber o, l_quantity cost, 'x_'||l_orderkey||'_'||l_linenumber v FROM lineitem), p AS (SELECT max(abs(cost))*10+1 penalty, count(DISTINCT g) n FROM c) "


@_query(_QUBO + "SELECT v AS i, v AS j, cost-penalty AS coef FROM c, p UNION ALL SELECT a.v, b.v, 2*penalty FROM c a JOIN c b ON a.g=b.g AND a.o<b.o, p")
def qubo_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return frontier.qubo(_costs(spark, d))[0]


@_query(_QUBO + "SELECT penalty, penalty*n AS constant FROM p")
def qubo_constant(spark: SparkSession, d: str) -> DataFrame:
    return frontier.qubo(_costs(spark, d))[1]


_FLAGS = " ".join(f"LEFT JOIN (SELECT l_orderkey, l_quantity q{f}, l_tax t{f} FROM lineitem WHERE l_returnflag = '{f}') {f} USING (l_orderkey)" for f in "ANR")


@_query(f"SELECT l_orderkey AS problem, round(min(c), 2) AS best, count(*)::BIGINT AS plans FROM (SELECT l_orderkey, {' + '.join(f'coalesce(q{f},0)' for f in 'ANR')} c, {' + '.join(f'coalesce(t{f},0)' for f in 'ANR')} t FROM (SELECT DISTINCT l_orderkey FROM lineitem) {_FLAGS}) WHERE round(t, 2) <= 0.12 GROUP BY 1")
def exhaustive_min(spark: SparkSession, d: str) -> DataFrame:
    """Of all products of choices (one line for each return flag of an order) within a tax budget, the cheapest."""
    choices = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("problem"), F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("cost"), F.col("l_tax").alias("load"))
    return frontier.exhaustive_plan(choices, ["A", "N", "R"], 0.12)


@_query("WITH b AS (SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END, '' ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END) AS bits FROM lineitem GROUP BY 1) SELECT l_orderkey, bits, length(replace(bits, '0', '')) = 1 AS valid, CASE WHEN length(replace(bits, '0', '')) = 1 THEN instr(bits, '1') END::INT AS chosen FROM b")
def one_hot_valid(spark: SparkSession, d: str) -> DataFrame:
    """A bit string per order, decoded to the one representation that it chooses."""
    bit = F.when(F.col("l_returnflag") == "R", "1").otherwise("0")
    rows = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", bit.alias("bit")))).alias("b"))
    bits = rows.select("l_orderkey", F.array_join(F.transform("b", lambda x: x["bit"]), "").alias("bits"))
    chosen = frontier.decode_one_hot(F.col("bits"))
    return bits.select("l_orderkey", "bits", chosen.isNotNull().alias("valid"), chosen.alias("chosen"))


_ONE_EACH = "SELECT l_orderkey g, l_linenumber o, min(l_quantity) cost, bool_or(l_returnflag = 'R') flag FROM lineitem GROUP BY 1, 2"


@_query(f"WITH c AS ({_ONE_EACH}), p AS (SELECT max(abs(cost))*10+1 penalty FROM c), e AS (SELECT g, sum(CASE WHEN flag THEN cost ELSE 0 END) s, count_if(flag) ones FROM c GROUP BY 1) SELECT round(sum(s + penalty*(1-ones)*(1-ones)), 4) AS energy FROM e, p")
def qubo_energy(spark: SparkSession, d: str) -> DataFrame:
    """Energy of one bit vector by the coefficients."""
    lines = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("ord"))
    lines = lines.agg(F.min("l_quantity").alias("cost"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("bit"))
    bits = lines.select(F.concat_ws("_", F.lit("x"), "group_id", "ord").alias("var"), "bit")
    return frontier.qubo_energy(*frontier.qubo(lines.drop("bit")), bits).select(F.round("energy", 4).alias("energy"))


@_query("SELECT l_orderkey, count_if(l_quantity <= 30 AND l_extendedprice <= 40000)::BIGINT AS feasible FROM lineitem GROUP BY 1")
def budget_feasible(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(frontier.within(("l_quantity", 30), ("l_extendedprice", 40000))).alias("feasible"))


@_query()
def adaptive_plan(spark: SparkSession, d: str) -> DataFrame:
    """The global plan in parts: a customer's orders are blocks, their lines representations; chosen line and totals."""
    lines = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").cast("long").alias("stored"), F.col("l_quantity").cast("long").alias("encode"), F.col("l_suppkey").cast("long").alias("decode"))
    orders = _read(spark, d, "orders").select(F.col("o_orderkey").alias("block"), F.col("o_custkey").alias("part"))
    return frontier.plan_parts(lines.join(orders, "block"))


# Lattice and recovery, over documents by size


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    sized = _read(spark, d, "documents").select(F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.col("doc_id").alias("key"))
    return lattice.size_groups(sized, "n_chars", "key")


def _edges(spark: SparkSession, d: str, grouped: DataFrame | None = None) -> DataFrame:
    met = lattice.pairs(_grouped(spark, d) if grouped is None else grouped, "key", "n_chars")
    return met.select("group_id", F.format_string("%09d", "a").alias("a"), F.format_string("%09d", "b").alias("b"), (F.abs(F.col("size_a") - F.col("size_b")) + lattice.OVERHEAD).alias("cost"))


_GROUPED = "g AS (SELECT coalesce(n_chars,0) n_chars, doc_id AS key, (row_number() OVER (ORDER BY coalesce(n_chars,0), doc_id)-1)//7 AS group_id, ((row_number() OVER (ORDER BY coalesce(n_chars,0), doc_id)-1)%7) AS pos FROM documents)"
_EDGES = _GROUPED + ", e AS (SELECT x.group_id, printf('%09d', x.key) a, printf('%09d', y.key) b, abs(x.n_chars-y.n_chars)+96 AS cost FROM g x JOIN g y ON x.group_id=y.group_id AND x.pos<y.pos)"
_MST = _EDGES + """, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY cost, a, b) rk FROM e),
r AS (SELECT group_id, rk, a AS node FROM k UNION SELECT r.group_id, r.rk, CASE WHEN k.a = r.node THEN k.b ELSE k.a END FROM r JOIN k ON k.group_id = r.group_id AND k.rk < r.rk AND (k.a = r.node OR k.b = r.node)),
t AS (SELECT group_id, a, b, cost FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.group_id = k.group_id AND r.rk = k.rk AND r.node = k.b))"""


@_query(f"WITH {_GROUPED} SELECT key, n_chars, group_id::BIGINT AS group_id, pos::INT AS pos FROM g")
def size_groups(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(spark, d).select("key", "n_chars", "group_id", "pos")


@_query(f"WITH {_EDGES} SELECT group_id::BIGINT AS group_id, a, b, cost FROM e")
def repair_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@_query(f"WITH RECURSIVE {_MST} SELECT group_id::BIGINT AS group_id, a, b, cost FROM t")
def mst_edges(spark: SparkSession, d: str) -> DataFrame:
    return lattice.mst(_edges(spark, d))


@_query(f"WITH RECURSIVE {_MST}, f AS (SELECT e.*, row_number() OVER (PARTITION BY e.group_id ORDER BY t.cost IS NULL, e.cost, e.a, e.b)::INT rk FROM e LEFT JOIN t ON e.group_id = t.group_id AND e.a = t.a AND e.b = t.b) SELECT group_id::BIGINT AS group_id, a, b, cost, rk FROM f WHERE rk <= 14")
def frontier_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are searched: the spanning tree first, then the cheapest others."""
    edges = _edges(spark, d)
    return lattice.frontier_edges(edges, lattice.mst(edges))


@_query(
    f"WITH RECURSIVE {_MST}, x AS (SELECT group_id, cost, row_number() OVER (PARTITION BY group_id ORDER BY cost, a, b) rn FROM e ANTI JOIN t USING (group_id, a, b)), "
    "w AS (SELECT group_id, sum(cost) wanted FROM (SELECT group_id, cost FROM t UNION ALL SELECT group_id, cost FROM x WHERE rn <= 2) GROUP BY 1), "
    "l AS (SELECT group_id, floor(sum(n_chars)*25.0/100)::BIGINT lim FROM g GROUP BY 1) SELECT group_id::BIGINT AS group_id, least(wanted, lim)::BIGINT AS budget FROM w JOIN l USING (group_id)"
)
def group_budget(spark: SparkSession, d: str) -> DataFrame:
    return _budgeted(spark, d)[1]


def _budgeted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and the budgets of their groups."""
    grouped = _grouped(spark, d)
    edges = _edges(spark, d, grouped)
    stored = grouped.select("group_id", F.col("n_chars").alias("stored"))
    return edges, lattice.group_budget(edges, stored, lattice.mst(edges), 25.0)


@_query()
def lattice_plan(spark: SparkSession, d: str) -> DataFrame:
    return lattice.plan(*_budgeted(spark, d))


@_query()
def lattice_report(spark: SparkSession, d: str) -> DataFrame:
    edges = lattice_plan(spark, d)
    ends = edges.select("group_id", "cost", F.explode(F.array("a", "b")).alias("v"))
    return ends.groupBy("group_id").agg((F.count("*") / 2).cast("long").alias("n_edges"), (F.sum("cost") / 2).cast("long").alias("bytes"), F.countDistinct("v").alias("protected"))


_BLOCKS = "b AS (SELECT sha256(text) AS key, any_value(encode(text)) raw, any_value(octet_length(encode(text))) n FROM documents WHERE text <> '' GROUP BY 1)"
_BLOCK_MST = _MST.replace(_GROUPED, _BLOCKS + ", g AS (SELECT key, n AS n_chars, (row_number() OVER (ORDER BY n, key)-1)//7 AS group_id, ((row_number() OVER (ORDER BY n, key)-1)%7) AS pos FROM b)").replace("printf('%09d', x.key)", "x.key").replace("printf('%09d', y.key)", "y.key")
_HIT = "substr(key, 1, 1) < '4'"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts as blocks (block_hash, raw, n)."""
    return _contents(spark, d).groupBy("block_hash").agg(F.any_value("raw").alias("raw")).withColumn("n", F.length("raw"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """Texts that aren't empty, with their hashes (block_hash, raw)."""
    return _docs(spark, d).filter(F.length("content") > 0).select(F.sha2("content", 256).alias("block_hash"), F.col("content").alias("raw"))


def _deltas(blocks: DataFrame) -> DataFrame:
    """Pair deltas of the blocks' size groups."""
    met = lattice.pairs(lattice.size_groups(blocks.select("block_hash", "n"), "n", "block_hash"), "block_hash", "n")
    for side in "ab":
        met = met.join(blocks.select(F.col("block_hash").alias(side), F.col("raw").alias(f"raw_{side}")), side)
    return lattice.deltas(met.select("group_id", "a", "b", "raw_a", "raw_b"))


_PADDED = "{x}.raw || repeat('\\x00'::BLOB, greatest({x}.n, {y}.n) - {x}.n)"


@_query(
    f"WITH {_BLOCKS}, g AS (SELECT key, raw, n, (row_number() OVER (ORDER BY n, key)-1)//7 AS group_id, ((row_number() OVER (ORDER BY n, key)-1)%7) AS pos FROM b) "
    f"SELECT x.group_id::BIGINT AS group_id, x.key AS a, y.key AS b, sha256(xor(({_PADDED.format(x='x', y='y')})::BIT, ({_PADDED.format(x='y', y='x')})::BIT)::BLOB) AS repair_hash, greatest(x.n, y.n)::INT AS delta_size "
    "FROM g x JOIN g y ON x.group_id = y.group_id AND x.pos < y.pos"
)
def xor_delta(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(_blocks(spark, d)).select("group_id", "a", "b", "repair_hash", F.length("delta").alias("delta_size"))


_LEVELS = f"b2 AS (SELECT a x, b y FROM t UNION ALL SELECT b, a FROM t), s(v, lvl) AS (SELECT key, 0 FROM g WHERE NOT ({_HIT}) UNION SELECT y, lvl+1 FROM s JOIN b2 ON x = s.v WHERE lvl < 6)"


@_query(f"WITH RECURSIVE {_BLOCK_MST}, {_LEVELS} SELECT v AS block_hash, min(lvl)::INT AS round FROM s GROUP BY 1")
def recovered_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that are intact, or rebuilt from a delta and a neighbour and then checked by their hash; those with a low hash are damaged."""
    keys = _contents(spark, d).select("block_hash", F.length("raw").alias("n")).distinct()
    groups = lattice.size_groups(keys, "n", "block_hash").select("block_hash", "group_id", "n")
    now = F.when(F.expr(_HIT.replace("key", "block_hash")), F.concat("raw", F.lit(b"!"))).otherwise(F.col("raw"))
    blocks = _blocks(spark, d).drop("n").join(groups, "block_hash").select("group_id", "block_hash", "n", "raw")
    return lattice.recover_grouped(blocks, now)


@_query(
    f"WITH RECURSIVE {_BLOCK_MST}, {_LEVELS}, m AS (SELECT v, min(lvl) l FROM s GROUP BY 1) "
    "SELECT (SELECT count(*) FROM g)::BIGINT AS blocks, count_if(l = 0)::BIGINT AS intact, count_if(l > 0)::BIGINT AS recovered, ((SELECT count(*) FROM g) - count(*))::BIGINT AS lost FROM m"
)
def archive_health(spark: SparkSession, d: str) -> DataFrame:
    total = _contents(spark, d).agg(F.countDistinct("block_hash").alias("blocks"))
    found = recovered_blocks(spark, d).agg(F.count_if(F.col("round") == 0).alias("intact"), F.count_if(F.col("round") > 0).alias("recovered"))
    return total.crossJoin(found).withColumn("lost", F.col("blocks") - F.col("intact") - F.col("recovered"))


# Catalogue


@_query(f"SELECT {_P} AS path, octet_length(encode(coalesce(text,'')))::BIGINT AS size, upper(left(sha256(coalesce(text,'')), 16)) AS hash16 FROM documents")
def list_archive(spark: SparkSession, d: str) -> DataFrame:
    return entry_manifest(spark, d).select("path", "size", F.upper(F.left("sha256", F.lit(16))).alias("hash16"))


@_query("SELECT DISTINCT coalesce(lang, doc_id || '.txt') AS name, lang IS NOT NULL AS is_dir FROM documents")
def list_directory(spark: SparkSession, d: str) -> DataFrame:
    rest = F.expr("substring(path, 11)")
    inside = _docs(spark, d).filter(F.startswith("path", F.lit("documents/")))
    return inside.select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), F.contains(rest, F.lit("/")).alias("is_dir")).distinct()


@_query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.org')")
def find_entries(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").filter(F.contains(F.lower("url"), F.lit("example.org"))).select("page_id", "url")


_NEW = "SELECT doc_id, 'new' AS origin FROM labels"


@_query(f"WITH n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def add_entries(spark: SparkSession, d: str) -> DataFrame:
    new = _read(spark, d, "labels").select("doc_id", F.lit("new").alias("origin"))
    return dedup.upsert(_read(spark, d, "documents").select("doc_id", F.lit("old").alias("origin")), new, "doc_id")


@_query(f"SELECT {_P} AS path FROM documents WHERE lang IS DISTINCT FROM 'fr'")
def delete_entries(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("documents/fr",)], "target string")
    return dedup.delete(_docs(spark, d).select("path"), targets)


@_query("SELECT p AS path, arg_max(src, o) AS source FROM (SELECT coalesce(text,'') AS p, 0 o, 'documents' src FROM documents UNION ALL SELECT coalesce(text,''), 1, 'benchmark' FROM benchmark) GROUP BY 1")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    names = ("documents", "benchmark")
    return store.merged([_read(spark, d, t).select(F.coalesce("text", F.lit("")).alias("path"), F.lit(t).alias("source")).distinct() for t in names])


@_query("WITH a AS (SELECT DISTINCT sha256(coalesce(text,'')) h FROM documents), b AS (SELECT DISTINCT sha256(coalesce(text,'')) h FROM benchmark) SELECT h AS record_hash, 'primary' AS kind FROM a UNION ALL SELECT h, 'repair' FROM b WHERE h NOT IN (SELECT h FROM a)")
def union_records(spark: SparkSession, d: str) -> DataFrame:
    hashed = lambda t, k: _read(spark, d, t).select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("record_hash"), F.lit(k).alias("kind")).distinct()
    return dedup.upsert(hashed("benchmark", "repair"), hashed("documents", "primary"), "record_hash")


@_query("SELECT page_id, CASE WHEN ends_with(lower(url),'.qbx') THEN 'qbx' WHEN starts_with(hex(encode(coalesce(html,''))), '504B0304') THEN 'zip' WHEN ends_with(lower(url),'.7z') THEN '7z' WHEN ends_with(lower(url),'.rar') THEN 'rar' ELSE 'none' END AS kind FROM pages")
def container_kind(spark: SparkSession, d: str) -> DataFrame:
    kind = scalars.container_kind(F.col("url"), F.coalesce("html", F.lit("")).cast("binary"))
    return _read(spark, d, "pages").select("page_id", F.coalesce(kind, F.lit("none")).alias("kind"))


@_query(f"SELECT page_id, {_SAFE_SQL} AS safe FROM (SELECT page_id, regexp_replace(url, '^https?:/', '') AS p FROM pages)")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", scalars.is_safe_path(F.regexp_replace("url", "^https?:/", "")).alias("safe"))


@_query("SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.2f MB', n/1048576.0) WHEN n >= 1024 THEN printf('%.2f KB', n/1024.0) ELSE replace(format('{:,}', n), ',', '.') || ' B' END AS size FROM (SELECT doc_id, octet_length(encode(coalesce(text,''))) n FROM documents)")
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", scalars.human_bytes(F.length("content")).alias("size"))


@_query("SELECT * FROM (VALUES ('qbx', true), ('zip', true), ('7z', false), ('rar', false)) t(format, available)")
def format_capabilities(spark: SparkSession, d: str) -> DataFrame:
    return bridge.capabilities(spark)


@_query("WITH base AS (SELECT lang AS name, sum(octet_length(encode(coalesce(text,''))))::BIGINT AS size FROM documents GROUP BY 1), cand AS (SELECT lang AS name, sum(n)::BIGINT AS size FROM (SELECT DISTINCT lang, text, octet_length(encode(coalesce(text,''))) n FROM documents) GROUP BY 1) SELECT max(b.size - c.size)::BIGINT AS best, bool_and(c.size <= b.size) AND max(b.size - c.size) >= 32 AS passed FROM base b JOIN cand c ON b.name IS NOT DISTINCT FROM c.name")
def release_gate(spark: SparkSession, d: str) -> DataFrame:
    """Reports of two forms, all bytes by language and those of distinct texts: none grows, and the best saves at least 32 bytes."""
    rows = _docs(spark, d).select(F.col("lang").alias("name"), "content", F.length("content").cast("long").alias("n"))
    base = rows.groupBy("name").agg(F.sum("n").alias("size"))
    return frontier.release_gate(base, rows.groupBy("name", F.sha2("content", 256)).agg(F.max("n").alias("n")).groupBy("name").agg(F.sum("n").alias("size")))


@_query("SELECT event_type, user_id, min(ts) AS first_ts FROM events GROUP BY 1, 2")
def incremental_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Extension: deduplication over the event table, batch side."""
    return incremental.first_seen(_read(spark, d, "events"), ["event_type", "user_id"]).select("event_type", "user_id", F.col("ts").alias("first_ts"))


@_query("SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the windowed counts of the stream, batch side."""
    return incremental.windowed_counts(_read(spark, d, "events")).select("event_type", F.col("w.start").alias("start"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
