"""Queries over contracts: shredding, matching with SDK calls, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sdkatlas.functions.rows import bounded_tasks
from sdkatlas.operators import contract, match, provenance, py_calls
from sdkatlas.plans import corpus
from sdkatlas.plans.registry import query
from sdkatlas.session import checkpointed, saved
from sdkatlas.plans.source_queries import LANGUAGE_SQL, PARTS, PY_PATH, SDK, SPEC, languages, metadata

WITH_BOTH = f"with {PARTS}, {SDK}, {SPEC} "

# The contract corpus over `part`, for the SQL side.
OPS = """ops as (select p_partkey // 50 as repo_id, p_partkey as p, p_size as size,
    case p_partkey % 5 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' when 3 then 'DELETE' else 'PATCH' end as http_method,
    '/parts/' || p_partkey || '/{tag_id}/x/{item_id}' as http_path,
    case p_partkey // 50 % 3 when 0 then 'python' when 1 then 'java' else 'typescript' end as language,
    case p_partkey % 6 when 1 then '{"name":"n' || p_partkey || '","role":"user"}' when 2 then '{"size":' || p_size || '}'
        when 3 then 'null' when 5 then '"text ' || p_partkey || '"' end as request_example,
    case p_partkey % 5 when 1 then '{"ok":' || p_partkey || '}' when 2 then '[' || p_partkey || ']' end as response_example,
    p_partkey % 5 = 0 as is_streaming from part)"""


@query("spec_scan", f"with {PARTS}, {SPEC} select distinct repo_id, repo_id % 5 <> 0 as readable from spec")
def spec_scan(spark, sf):
    broken = F.when(F.col("repo_id") % 5 == 0, F.substr("doc", F.lit(1), F.length("doc") - 2)).otherwise(F.col("doc"))
    specs = corpus.spec_documents(spark, sf).withColumn("doc", broken)
    return specs.select("repo_id", contract.is_document(F.col("doc")).alias("readable"))


@query("spec_operations", f"with {PARTS}, {SPEC} select * from spec")
def spec_operations(spark, sf):
    return contract.operations(corpus.spec_documents(spark, sf)).select("repo_id", "http_method", "http_path", "raw_path")


@query("spec_load_status", f"""with {PARTS}, {SPEC} select repo_id, count(distinct raw_path) as paths,
    case when repo_id % 3 = 0 then 0 else count(*) end as endpoints, case when repo_id % 3 = 0 then 'no_endpoints' else 'ok' end as status
    from spec group by repo_id""")
def spec_load_status(spark, sf):
    odd = F.regexp_replace("doc", '"(get|post|put|delete|patch)": ', '"X-$1": ')
    specs = corpus.spec_documents(spark, sf).withColumn("doc", F.when(F.col("repo_id") % 3 == 0, odd).otherwise(F.col("doc")))
    specs = saved(specs)  # written out once for both of its uses
    return contract.load_status(specs, contract.operations(specs))


def contract_ops(spark, sf):
    return contract.operations(corpus.contract_documents(spark, sf))


@query("param_refs", f"""with {OPS} select repo_id, http_path, level, ord, found, location, name, required from ops, (values
    ('path', 0, true, 'path', 'itemID', true, 9), ('path', 1, true, 'query', 'page_size', true, 9), ('path', 2, false, null, null, false, 9),
    ('operation', 0, true, 'path', 'tagId', true, 9), ('operation', 1, true, 'query', 'page_size', false, 0), ('operation', 2, true, 'header', 'X-Trace', false, 0),
    ('operation', 1, true, 'header', 'X-Trace', false, 1)) v(level, ord, found, location, name, required, when_)
    where when_ = 9 or (when_ = 0 and p % 3 = 0) or (when_ = 1 and p % 3 <> 0)""")
def param_refs(spark, sf):
    ops = contract_ops(spark, sf)
    level = lambda name, column: ops.select("repo_id", "http_path", F.lit(name).alias("level"), F.posexplode(column).alias("ord", "param"))
    both = level("path", "path_params_listed").unionByName(level("operation", "op_params_listed"))
    return both.select("repo_id", "http_path", "level", "ord", "param.found", "param.location", "param.name", "param.required")


@query("param_merge", f"""with {OPS} select repo_id, http_path, ord, found, location, name, required from ops, (values
    (0, true, 'path', 'itemID', true, 9), (1, false, null, null, false, 0), (2, true, 'path', 'tagId', true, 0), (3, true, 'query', 'page_size', false, 0),
    (4, true, 'header', 'X-Trace', false, 0), (1, true, 'query', 'page_size', true, 1), (2, false, null, null, false, 1), (3, true, 'path', 'tagId', true, 1),
    (4, true, 'header', 'X-Trace', false, 1)) v(ord, found, location, name, required, when_)
    where when_ = 9 or (when_ = 0 and p % 3 = 0) or (when_ = 1 and p % 3 <> 0)""")
def param_merge(spark, sf):
    merged = contract.merge_parameters(contract_ops(spark, sf))
    return (merged.select("repo_id", "http_path", F.posexplode("params").alias("ord", "param"))
            .select("repo_id", "http_path", "ord", "param.found", "param.location", "param.name", "param.required"))


def named(params):
    return F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit(":"), p["required"].cast("string"))), ",")


@query("param_split", f"""with {OPS} select repo_id, http_path, 'itemID:true,tagId:true' as path_params,
    case when p % 3 = 0 then 'page_size:false' else 'page_size:true' end as query_params from ops""")
def param_split(spark, sf):
    split = contract.split_parameters(contract.merge_parameters(contract_ops(spark, sf)))
    return split.select("repo_id", "http_path", named(F.col("path_params")).alias("path_params"), named(F.col("query_params")).alias("query_params"))


def request_media(spark, sf):
    content = F.from_json("op", "struct<requestBody:struct<content:string>>")["requestBody"]["content"]
    return contract_ops(spark, sf).select("repo_id", "http_path", contract.json_media(content).alias("picked"))


@query("json_media", f"""with {OPS} select repo_id, http_path, case p % 6 when 0 then null when 2 then 'application/x+json'
    when 3 then 'application/merge+json' else 'application/json' end as content_type from ops""")
def json_media(spark, sf):
    return request_media(spark, sf).select("repo_id", "http_path", "picked.content_type")


@query("example_pick", f"with {OPS} select repo_id, http_path, request_example as example from ops")
def example_pick(spark, sf):
    return request_media(spark, sf).select("repo_id", "http_path", contract.example_of(F.col("picked.media")).alias("example"))


@query("response_pick", f"with {OPS} select repo_id, http_path, is_streaming, response_example as example from ops")
def response_pick(spark, sf):
    responses = F.from_json("op", "struct<responses:string>")["responses"]
    return contract_ops(spark, sf).select("repo_id", "http_path", F.inline(F.array(contract.success_response(responses))))


@query("spec_endpoints", f"""with {OPS} select repo_id, http_method, http_path, 'itemID:true,tagId:true' as path_params,
    case when p % 3 = 0 then 'page_size:false' else 'page_size:true' end as query_params, case p % 6 when 0 then null when 2 then 'object' when 3 then 'array'
      when 5 then 'union' else '#/components/schemas/item_Part' || p end as body, request_example, response_example, is_streaming from ops""")
def spec_endpoints(spark, sf):
    shape = F.from_json("body_schema", "struct<`$ref`:string,type:string>")
    body = F.when(F.col("body_schema").isNotNull(), F.coalesce(shape["$ref"], shape["type"], F.lit("union")))
    return contract.endpoints(corpus.contract_documents(spark, sf)).select(
        "repo_id", "http_method", "http_path", named(F.col("path_params")).alias("path_params"), named(F.col("query_params")).alias("query_params"),
        body.alias("body"), "request_example", "response_example", "is_streaming")


def endpoint_relation(spark, sf):
    path = F.regexp_replace(F.regexp_replace("raw_path", "itemID", "item_id"), "tagId", "tag_id")
    return corpus.spec_side(spark, sf).select("repo_id", F.upper("verb").alias("http_method"), path.alias("http_path"), "raw_path")


def mapping_relation(spark, sf):
    return corpus.sdk_side(spark, sf).select(
        "repo_id", F.upper("verb").alias("http_method"), F.concat(F.lit("/"), "call_path").alias("http_path"),
        F.when(F.col("p") % 2 == 0, "src/shop/items/raw_client.py").otherwise("src/shop/items/resources/extra/raw_client.py").alias("path"),
        F.col("p").alias("ord"))


LAST = f"(select repo_id, verb as http_method, http_path, {PY_PATH} as path, p as ord from sdk qualify row_number() over (partition by repo_id, verb, http_path order by p % 2 desc, p desc) = 1)"


@query("mapping_index", f"{WITH_BOTH} select * from {LAST}")
def mapping_index(spark, sf):
    return match.mapping_index(mapping_relation(spark, sf))


@query("matched", f"{WITH_BOTH} select repo_id, http_method, http_path, raw_path, path, ord from spec join {LAST} using (repo_id, http_method, http_path)")
def matched(spark, sf):
    return match.matched(endpoint_relation(spark, sf), match.mapping_index(mapping_relation(spark, sf)))


@query("unmatched", f"""{WITH_BOTH} select repo_id, http_method, http_path, raw_path from spec where not exists (
    select 1 from sdk where sdk.repo_id = spec.repo_id and verb = http_method and sdk.http_path = spec.http_path)""")
def unmatched(spark, sf):
    return match.unmatched(endpoint_relation(spark, sf), mapping_relation(spark, sf))


@query("orphans", f"""{WITH_BOTH} select repo_id, verb as http_method, http_path, {PY_PATH} as path, p as ord from sdk where not exists (
    select 1 from spec where sdk.repo_id = spec.repo_id and verb = http_method and sdk.http_path = spec.http_path)""")
def orphans(spark, sf):
    return match.orphans(endpoint_relation(spark, sf), mapping_relation(spark, sf))


COVERAGE = f"""coverage as (select repo_id, cast(coalesce(sum(s), 0) as bigint) as total, cast(coalesce(sum(case when m > 0 then s end), 0) as bigint) as matched,
    cast(coalesce(sum(case when m = 0 then s end), 0) as bigint) as unmatched, cast(coalesce(sum(m), 0) as bigint) as sdk_endpoints,
    cast(coalesce(sum(case when s = 0 then m end), 0) as bigint) as orphans from (
      select repo_id, http_method, http_path, sum(s) as s, sum(m) as m from (
        select repo_id, http_method, http_path, 1 as s, 0 as m from spec union all
        select repo_id, verb, http_path, 0, 1 from (select distinct repo_id, {PY_PATH} as path, verb, http_path from sdk)) group by all) group by repo_id)"""


def text_coverage(spark, sf):
    """Coverage from contract text and Python source text."""
    return match.coverage(contract.operations(corpus.spec_documents(spark, sf)), py_calls.python_endpoints(corpus.python_files(spark, sf)))


@query("coverage", f"{WITH_BOTH}, {COVERAGE} select * from coverage")
def coverage(spark, sf):
    return text_coverage(spark, sf)


@query("coverage_totals", f"""{WITH_BOTH}, {COVERAGE}, {LANGUAGE_SQL} select language, count(*) as repos, cast(sum(total) as bigint) as total, cast(sum(matched) as bigint) as matched,
    cast(sum(unmatched) as bigint) as unmatched, cast(sum(sdk_endpoints) as bigint) as sdk_endpoints, cast(sum(orphans) as bigint) as orphans
    from coverage c join languages l on l.repo_id = c.repo_id // 1000000000 where language is not null group by rollup (language)""")
def coverage_totals(spark, sf):
    mappings = py_calls.first_per_file(mapping_relation(spark, sf))
    per_repo = checkpointed(bounded_tasks(match.coverage(endpoint_relation(spark, sf), mappings)))  # used twice below
    supplier = languages(spark, sf).filter("language is not null").select(F.col("repo_id").alias("supplier"), "language")
    per_language = per_repo.withColumn("supplier", F.floor(F.col("repo_id") / 1000000000)).join(supplier, "supplier").select("repo_id", "language")
    return match.coverage_totals(per_repo, per_language)


@query("join_status", f"""{WITH_BOTH}, {COVERAGE} select repo_id, total, case when repo_id % 4 = 1 then 0 else matched end as matched, sdk_endpoints,
    case when total > 0 and sdk_endpoints > 0 and (matched = 0 or repo_id % 4 = 1) then 'no_match' else 'ok' end as status from coverage""")
def join_status(spark, sf):
    mappings = py_calls.first_per_file(mapping_relation(spark, sf))
    moved = F.when(F.col("repo_id") % 4 == 1, F.concat(F.lit("/v2"), "http_path")).otherwise(F.col("http_path"))
    per_repo = match.coverage(endpoint_relation(spark, sf), mappings.withColumn("http_path", moved))
    return match.join_status(per_repo).select("repo_id", "total", "matched", "sdk_endpoints", "status")


@query("examples", f"""with {OPS} select repo_id, http_method, http_path, coalesce(request_example, 'null') as request_body,
    coalesce(response_example, 'null') as response_body, case when is_streaming then true end as streaming from ops""")
def examples(spark, sf):
    rows = match.matched(contract.endpoints(corpus.contract_documents(spark, sf)), match.mapping_index(corpus.contract_mappings(spark, sf)))
    return match.examples(rows).select("repo_id", "http_method", "http_path", "request_body", "response_body", "streaming")


VERSION = "case s_suppkey % 4 when 0 then null when 1 then 'stale' else 'c' || s_suppkey end"


@query("provenance", f"""with m as (select s_suppkey as repo_id, case when s_suppkey % 7 = 0 then '' else 'c' || s_suppkey end as origin_commit,
      case when s_suppkey % 9 <> 0 then {VERSION} end as spec_version from supplier where s_suppkey % 10 <> 0)
    select *, case when repo_id % 9 = 0 then 'spec_missing' when origin_commit = '' then 'commit_missing' when spec_version is null then 'version_missing'
      when spec_version <> origin_commit then 'mismatch' else 'ok' end as status from m""")
def provenance_query(spark, sf):
    key = F.col("s_suppkey")
    version = F.when(key % 4 == 1, "stale").when(key % 4 != 0, F.concat(F.lit("c"), key))
    doc = F.to_json(F.struct(F.struct(F.lit("t").alias("title"), version.alias("version")).alias("info")))
    specs = corpus.table(spark, sf, "supplier").filter(key % 9 != 0).select(key.alias("repo_id"), doc.alias("doc"))
    return provenance.audit(metadata(spark, sf), specs)


@query("spec_lookup", """with m as (select s_suppkey as repo_id, case when s_suppkey % 7 = 0 then '' else 'c' || s_suppkey end as origin_commit from supplier where s_suppkey % 10 <> 0)
    select *, case when origin_commit = '' then 'invalid' when exists (select 1 from lineitem where l_suppkey = repo_id and l_linenumber = 1 and l_quantity > 45) then 'ready' else 'pending' end as status from m""")
def spec_lookup(spark, sf):
    published = corpus.table(spark, sf, "lineitem").filter("l_linenumber = 1 and l_quantity > 45").select(
        F.concat(F.lit("c"), "l_suppkey").alias("origin_commit"), F.lit("{}").alias("doc"))
    return provenance.spec_lookup(metadata(spark, sf), published)
