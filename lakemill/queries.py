"""The catalogue of relational queries, each with the SQL that an independent engine answers the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.functions import json as J
from lakemill.operators import relops as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str, *tables: str):
    """Registers a query over the named tables, which it gets as DataFrames, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[scan(spark, sf_dir, t) for t in tables])
        ORACLES[f.__name__] = sql
        return f

    return put


def text(name: str, sql: str, oracle: str | None = None) -> None:
    """Registers a query given in the dialect of this library; ``oracle`` where that engine's spelling differs."""

    def run(spark, sf_dir):
        from lakemill.plans.session import Database

        return Database.over_parquet(spark, sf_dir).execute(sql).rows

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (scan(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = R.join(R.join(orders.where(c("o_totalprice") > 1000), customer, c("o_custkey") == c("c_custkey")), nation, c("c_nationkey") == c("n_nationkey"))
    out = R.aggregate(joined, ["n_name"], n_orders=F.count(F.lit(1)), total=F.round(F.sum("o_totalprice"), 2), largest=F.max("o_totalprice"))
    return R.sort(out, "-total", "n_name")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = "select n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total, max(o_totalprice) as largest from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 1000 group by n_name"


@query("select * from supplier", "supplier")
def scan_full(t):
    return t


@query("select * from orders where o_orderkey = 42", "orders")
def index_point_lookup(t):
    return R.index_search(t, o_orderkey=42)


@query("select o_orderkey from orders where o_orderkey between 100 and 200", "orders")
def index_range_inclusive(t):
    return R.index_range(t, ["o_orderkey"], (100,), (200,)).select("o_orderkey")


@query("select l_orderkey, l_linenumber from lineitem where (l_orderkey > 10 or l_orderkey = 10 and l_linenumber >= 2) and (l_orderkey < 20 or l_orderkey = 20 and l_linenumber <= 3)", "lineitem")
def index_range_composite(t):
    return R.index_range(t, ["l_orderkey", "l_linenumber"], (10, 2), (20, 3)).select("l_orderkey", "l_linenumber")


@query("select n_regionkey, n_name, n_nationkey from nation", "nation")
def project_reorder(t):
    return t.select("n_regionkey", "n_name", "n_nationkey")


# Every operator of a SELECT in this library's own dialect; integer / is div, so the oracle spells it //.
for _name, _sql, _oracle in (
    ("project_alias_literal", "select 1 as one, n_name as name, 'x' as tag from nation", "select 1::bigint as one, n_name as name, 'x' as tag from nation"),
    ("filter_cmp", "select o_orderkey from orders where o_totalprice >= 1000.5 and o_orderkey <> 7 and o_orderkey < 5000", None),
    ("filter_and_or_not", "select o_orderkey from orders where not (o_orderstatus = 'F' or o_totalprice < 500.0) and o_custkey > 10", None),
    ("filter_in", "select n_name from nation where n_regionkey in (1, 3)", None),
    ("filter_not_in", "select n_name from nation where n_regionkey not in (1, 3)", None),
    ("filter_between", "select p_partkey from part where p_size between 5 and 10", None),
    ("filter_not_between", "select p_partkey from part where p_size not between 5 and 10", None),
    ("filter_like", "select p_name from part where p_type like '%A_%' or p_name like 'p%1'", None),
    ("filter_not_like", "select p_name from part where p_name not like '%1%'", None),
    ("expr_arith_int", "select o_orderkey + o_custkey * 2 - 1 as v from orders", None),
    ("expr_arith_float", "select l_orderkey, l_linenumber, l_extendedprice * (1.0 - l_discount) as v from lineitem", "select l_orderkey, l_linenumber, l_extendedprice * (1.0::double - l_discount) as v from lineitem"),
    ("expr_int_div", "select o_orderkey / 7 as v from orders", "select o_orderkey // 7 as v from orders"),
    ("case_searched", "select c_custkey, case when c_acctbal < 0.0 then 'low' when c_acctbal < 5000.0 then 'mid' else 'high' end as band from customer", None),
    ("case_simple", "select n_name, case n_regionkey when 0 then 'zero' when 1 then 'one' end as r from nation", None),
    ("join_inner_equi", "select n_name, r_name from nation join region on n_regionkey = r_regionkey", None),
    ("join_inner_theta", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_nationkey < b.n_nationkey", None),
    ("join_compound", "select s_suppkey, c_custkey from supplier join customer on s_nationkey = c_nationkey and s_acctbal > c_acctbal", None),
    ("join_left", "select documents.doc_id as doc_id, toxic from documents left join labels on documents.doc_id = labels.doc_id", None),
    ("join_left_theta", "select r_name, n_name from region left join nation on r_regionkey > n_nationkey", None),
    ("join_right", "select labels.doc_id as l, documents.doc_id as d from labels right join documents on labels.doc_id = documents.doc_id", None),
    ("join_full", "select c_nationkey, s_suppkey from customer full join supplier on c_custkey = s_suppkey", None),
    ("join_full_theta", "select r_name, n_name from region full join nation on r_regionkey > n_nationkey", None),
    ("join_cross", "select r_name, n_name from region cross join nation", None),
    ("join_comma", "select r_name, n_name from region, nation where r_regionkey = n_regionkey", None),
    ("join_using", "select documents.doc_id as a, labels.doc_id as b, quality from documents join labels using (doc_id)", None),
    ("join_three_way", "select c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", None),
    ("join_self", "select a.s_suppkey as x, b.s_suppkey as y from supplier a join supplier b on a.s_nationkey = b.s_nationkey", None),
    ("agg_count_star", "select count(*) as n from lineitem", None),
    ("agg_count_col", "select count(toxic) as n from documents left join labels on documents.doc_id = labels.doc_id", None),
    ("agg_sum_int", "select sum(l_linenumber) as s from lineitem", "select sum(l_linenumber)::bigint as s from lineitem"),
    ("agg_sum_float", "select l_returnflag, sum(l_quantity) as s from lineitem group by l_returnflag", None),
    ("agg_avg", "select l_returnflag, avg(l_linenumber) as a from lineitem group by l_returnflag", None),
    ("agg_min_max", "select min(o_totalprice) as lo, max(o_totalprice) as hi, min(o_orderdate) as d from orders", None),
    ("agg_min_max_string", "select min(n_name) as lo, max(n_name) as hi from nation", None),
    ("agg_expr_arg", "select l_linestatus, sum(l_linenumber * 2) as s from lineitem group by l_linestatus", "select l_linestatus, sum(l_linenumber * 2)::bigint as s from lineitem group by l_linestatus"),
    ("agg_empty_input", "select count(*) as n, sum(o_orderkey) as s, min(o_orderkey) as m from orders where o_orderkey < 0", "select count(*) as n, sum(o_orderkey)::bigint as s, min(o_orderkey) as m from orders where o_orderkey < 0"),
    ("group_by_multi", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by l_returnflag, l_linestatus", None),
    ("group_by_no_agg", "select c_mktsegment from customer group by c_mktsegment", None),
    ("having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", None),
    ("group_order", "select c_nationkey, count(*) as n from customer group by c_nationkey order by n desc, c_nationkey limit 5", None),
    ("sort_hidden_key", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10", None),
    ("limit_offset", "select o_orderkey from orders order by o_orderkey limit 10 offset 5", None),
    ("offset_only", "select n_nationkey from nation order by n_nationkey offset 20", None),
    ("distinct", "select distinct c_mktsegment, c_nationkey from customer", None),
    ("distinct_order", "select distinct o_orderpriority from orders order by o_orderpriority", None),
    ("union_all", "select c_nationkey as k from customer union all select s_nationkey from supplier", None),
    ("union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier", None),
    ("intersect_distinct", "select c_nationkey as k from customer intersect select s_nationkey from supplier", None),
    ("except_distinct", "select c_nationkey as k from customer except select s_nationkey from supplier", None),
    ("json_get", "select event_id, props -> 'k' as v from events", "select event_id, nullif((props::json -> 'k')::varchar, 'null') as v from events"),
    ("json_get_text", "select event_id, props ->> 'k' as v from events", "select event_id, props::json ->> 'k' as v from events"),
    ("json_path", "select event_id, props #> '{k}' as v from events", "select event_id, json_extract(props, '$.k')::varchar as v from events"),
    ("json_path_text", "select event_id, props #>> '{k}' as v from events", "select event_id, json_extract_string(props, '$.k') as v from events"),
    ("json_has_key", "select event_id from events where props ? 'k'", "select event_id from events where json_exists(props, 'k')"),
    ("json_contains", "select event_id from events where props @> '{\"k\": 87}'", "select event_id from events where json_extract(props, '$.k')::varchar = '87'"),
    ("json_contained_by", "select event_id from events where '{\"k\": 87}' <@ props", "select event_id from events where json_extract(props, '$.k')::varchar = '87'"),
):
    text(_name, _sql, _oracle)


@query("select doc_id, nullif(lang, 'en') as lang from documents where nullif(lang, 'en') is null or nullif(source, 'src1') is not null", "documents")
def filter_is_null(t):
    lang = F.nullif(c("lang"), F.lit("en"))
    return R.filter_(t, lang.isNull() | F.nullif(c("source"), F.lit("src1")).isNotNull()).select("doc_id", lang.alias("lang"))


@query("select o_orderkey, c_custkey from orders left join customer on o_custkey = c_custkey and c_acctbal > o_totalprice", "orders", "customer")
def join_residual(o, k):
    return R.join(o, k, c("o_custkey") == c("c_custkey"), "left", residual=c("c_acctbal") > c("o_totalprice")).select("o_orderkey", "c_custkey")


@query("select n_regionkey, n_name from nation order by n_regionkey desc nulls last, n_name", "nation")
def sort_multi(t):
    return R.sort(t, "-n_regionkey", "n_name").select("n_regionkey", "n_name")


@query("select c_nationkey as k from customer semi join (select s_nationkey from supplier where s_acctbal > 9000.0) on c_nationkey is not distinct from s_nationkey", "customer", "supplier")
def intersect_keep_dups(a, b):
    return R.intersect(a.select(c("c_nationkey").alias("k")), b.where("s_acctbal > 9000.0").select("s_nationkey"), True)


@query("select c_nationkey as k from customer anti join (select s_nationkey from supplier where s_acctbal > 9000.0) on c_nationkey is not distinct from s_nationkey", "customer", "supplier")
def except_keep_dups(a, b):
    return R.except_(a.select(c("c_nationkey").alias("k")), b.where("s_acctbal > 9000.0").select("s_nationkey"), True)


@query("select event_id, (props::json ->> 'k') = '87' as v from events", "events")
def json_contains_dynamic(t):
    return t.select("event_id", J.contains_dynamic(c("props"), F.lit('{"k": 87}')).alias("v"))


@query("select o_orderkey from orders anti join (select c_custkey from customer where c_custkey > 100) on o_custkey = c_custkey", "orders", "customer")
def fk_orphans(o, k):
    return R.join(o, k.where("c_custkey > 100"), c("o_custkey") == c("c_custkey"), "anti").select("o_orderkey")


@query("select c_nationkey, count(*) as n from customer group by c_nationkey having count(*) > 1", "customer")
def unique_violations(t):
    return R.aggregate(t, ["c_nationkey"], n=F.count(F.lit(1))).where("n > 1")


def _script(*statements: str):
    def run(spark, sf_dir):
        from lakemill.plans.session import Database

        db = Database.over_parquet(spark, sf_dir)
        for s in statements[:-1]:
            db.execute(s)
        return db.execute(statements[-1]).rows

    return run


QUERIES["dml_insert_select_snapshot"] = _script("insert into nation select n_nationkey + 100, n_name, n_regionkey from nation where n_regionkey = 1", "select n_nationkey, n_name from nation")
ORACLES["dml_insert_select_snapshot"] = "select n_nationkey, n_name from nation union all select n_nationkey + 100, n_name from nation where n_regionkey = 1"
QUERIES["dml_update_snapshot"] = _script("update supplier set s_nationkey = s_nationkey + 1, s_acctbal = 0.0 where s_suppkey < 10", "select * from supplier")
ORACLES["dml_update_snapshot"] = "select s_suppkey, s_name, case when s_suppkey < 10 then s_nationkey + 1 else s_nationkey end as s_nationkey, case when s_suppkey < 10 then 0.0 else s_acctbal end as s_acctbal from supplier"
QUERIES["dml_delete_snapshot"] = _script("delete from supplier where s_acctbal < 1000.0", "select s_suppkey from supplier")
ORACLES["dml_delete_snapshot"] = "select s_suppkey from supplier where not s_acctbal < 1000.0"


def _refused(*statements: str, then: str):
    """A script of which some statements break a constraint: each is undone, and the last query shows what is left."""

    def run(spark, sf_dir):
        from lakemill.plans.errors import EngineError
        from lakemill.plans.session import Database

        db, refused = Database.over_parquet(spark, sf_dir), []
        for s in statements:
            try:
                db.execute(s)
            except EngineError as e:
                refused.append(type(e).__name__)
        return db.execute(then).rows.withColumn("refused", F.lit(",".join(refused)))

    return run


_REGIONS = "create table r (id int primary key, name string unique, n int not null default 7, constraint small check (id < 100)); insert into r (id, name) select r_regionkey, r_name from region"
QUERIES["dml_auto_increment"] = _script("create table t (id bigint not null auto_increment, v int)", "insert into t (v) values (10), (20)", "insert into t (v) values (30)", "select id, v from t")
ORACLES["dml_auto_increment"] = "select * from (values (1::bigint, 10::integer), (2, 20), (3, 30)) t(id, v)"
QUERIES["constraint_check"] = _refused(_REGIONS, "insert into r (id, name) values (100, 'x')", "update r set id = id + 99", then="select id, name, n from r")
ORACLES["constraint_check"] = "select r_regionkey as id, r_name as name, 7::integer as n, 'CheckViolation,CheckViolation' as refused from region"
QUERIES["constraint_check_not_valid"] = _refused(_REGIONS, "alter table r add constraint low check (id < 2) not valid", "insert into r (id, name) values (50, 'x')", "insert into r (id, name) values (-1, 'y')", then="select id, name from r")
ORACLES["constraint_check_not_valid"] = "select r_regionkey as id, r_name as name, 'CheckViolation' as refused from region union all select -1, 'y', 'CheckViolation'"
QUERIES["constraint_unique_and_primary_key"] = _refused(_REGIONS, "insert into r (id, name) select r_regionkey, 'z' from region", "insert into r (id, name) select r_regionkey + 10, r_name from region", "insert into r (id, name) values (null, 'q')", "insert into r (id, name, n) values (9, 'q', null)", then="select id, name from r")
ORACLES["constraint_unique_and_primary_key"] = "select r_regionkey as id, r_name as name, 'UniqueViolation,UniqueViolation,NotNullViolation,NotNullViolation' as refused from region"
_CHILDREN = "create table c (id int, rid int references r (id) on delete {0} on update {0}); insert into c select n_nationkey, n_regionkey from nation"
QUERIES["fk_checked"] = _refused(_REGIONS, _CHILDREN.format("restrict"), "insert into c values (99, 77)", "delete from r where id = 1", then="select id, rid from c")
ORACLES["fk_checked"] = "select n_nationkey as id, n_regionkey as rid, 'ForeignKeyViolation,ForeignKeyViolation' as refused from nation"
QUERIES["fk_cascade"] = _script(_REGIONS, _CHILDREN.format("cascade"), "delete from r where id = 1", "update r set id = 50 where id = 2", "select id, rid from c")
ORACLES["fk_cascade"] = "select n_nationkey as id, case n_regionkey when 2 then 50 else n_regionkey end as rid from nation where n_regionkey <> 1"
QUERIES["fk_set_null"] = _script(_REGIONS, _CHILDREN.format("set null"), "delete from r where id = 1", "select id, rid from c")
ORACLES["fk_set_null"] = "select n_nationkey as id, nullif(n_regionkey, 1) as rid from nation"
QUERIES["insert_defaults"] = _script("create table t (id int default 5, s string default 'dark', f float default 1.0 / 4.0)", "insert into t default values", "insert into t (id) values (6)", "select id, s, f from t")
ORACLES["insert_defaults"] = "select * from (values (5::integer, 'dark', 0.25::double), (6, 'dark', 0.25)) t(id, s, f)"
QUERIES["alter_columns"] = _script("alter table nation add column score int default 42", "alter table nation rename column n_name to label", "alter table nation drop column n_regionkey", "insert into nation (n_nationkey, label) values (99, 'new')", "alter table nation rename to land", "select * from land")
ORACLES["alter_columns"] = "select n_nationkey, n_name as label, 42::integer as score from nation union all select 99, 'new', 42"
QUERIES["transaction_rollback"] = _script("begin", "delete from nation", "rollback", "begin; insert into nation values (100, 'kept', 0); commit", "select n_nationkey, n_name from nation")
ORACLES["transaction_rollback"] = "select n_nationkey, n_name from nation union all select 100, 'kept'"
QUERIES["transaction_savepoints"] = _script("begin; insert into nation values (100, 'a', 0); savepoint s; delete from nation; savepoint t; insert into nation values (101, 'b', 0); rollback to s; insert into nation values (102, 'c', 0); release s; commit", "select n_nationkey, n_name from nation")
ORACLES["transaction_savepoints"] = "select n_nationkey, n_name from nation union all select 100, 'a' union all select 102, 'c'"
QUERIES["script_comments_precedence"] = _script("select n_nationkey + n_regionkey * 2 - 1 as v, /* both */ n_nationkey > 3 or n_regionkey = 1 and not n_nationkey = 2 as w -- end\n from nation")
ORACLES["script_comments_precedence"] = "select n_nationkey + n_regionkey * 2 - 1 as v, n_nationkey > 3 or (n_regionkey = 1 and (not n_nationkey = 2)) as w from nation"
text("division_in_join", "select s_suppkey, p_partkey from supplier join part on s_acctbal / 2.0 = p_retailprice / 2.0 or s_suppkey = p_partkey / 5", "select s_suppkey, p_partkey from supplier join part on s_acctbal / 2.0 = p_retailprice / 2.0 or s_suppkey = p_partkey // 5")
text("aggregate_in_expression", "select o_orderstatus, sum(o_custkey) + count(*) * 2 as v, 'x' as lit from orders group by o_orderstatus having max(o_custkey) > 1")
text("distinct_order_hidden", "select distinct l_returnflag from lineitem order by l_linestatus", "select distinct l_returnflag from lineitem")
QUERIES["three_valued_logic"] = _script("create table t (id int, a int, b int)", "insert into t select n_nationkey, case when n_regionkey > 1 then n_regionkey end, case when n_nationkey > 9 then n_nationkey end from nation", "select id, a = b as e, a > 1 and b > 10 as x, a > 1 or b > 10 as y, not a = 2 as n, a in (2, b) as i, a is null as z from t")
ORACLES["three_valued_logic"] = "select id, a = b as e, a > 1 and b > 10 as x, a > 1 or b > 10 as y, not a = 2 as n, a in (2, b) as i, a is null as z from (select n_nationkey as id, case when n_regionkey > 1 then n_regionkey end as a, case when n_nationkey > 9 then n_nationkey end as b from nation)"
QUERIES["group_by_null_key"] = _script("create table t (id int, a int)", "insert into t select n_nationkey, case when n_regionkey > 1 then n_regionkey end from nation", "select a, count(*) as n, count(a) as m, sum(id) as s from t group by a")
ORACLES["group_by_null_key"] = "select a, count(*) as n, count(a) as m, sum(n_nationkey)::bigint as s from (select n_nationkey, case when n_regionkey > 1 then n_regionkey end as a from nation) group by a"
QUERIES["json_key_from_column"] = _script("create table t (id bigint, j json, k string, p string)", "insert into t select event_id, props, 'k', '{k}' from events", "select id, j ->> k as v, j #>> p as w, j ? k as h from t")
ORACLES["json_key_from_column"] = "select event_id as id, props::json ->> 'k' as v, props::json ->> 'k' as w, json_exists(props::json, '$.k') as h from events"
QUERIES["time_literals"] = _script("create table t (id int, at time)", "insert into t values (1, '10:30:00'), (2, '23:59:59.5')", "select id, at from t where at > 1")
ORACLES["time_literals"] = 'select 1::integer as id, 37800000000::bigint as "at" union all select 2, 86399500000'
