"""Queries over source trees: scans, extraction in three languages, column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sdkatlas.functions import text as tx
from sdkatlas.operators import java_calls, py_calls, ts_calls
from sdkatlas.operators.match import extraction_status
from sdkatlas.plans import corpus
from sdkatlas.plans.registry import query
from sdkatlas.sources import artifacts, repo, trees

# Relations the corpus texts are written from, for the SQL side.
PARTS = """
parts as (select p_partkey as p, cast(p_size as varchar) as size, lower(p_type) as kind,
    case p_partkey % 5 when 0 then 'GET' when 1 then 'POST' when 2 then 'PUT' when 3 then 'DELETE' else 'PATCH' end as verb,
    case p_partkey % 4 when 0 then '/parts/' || p_partkey when 1 then '/parts/' || p_partkey || '/{item_id}'
        when 2 then '/parts/' || p_partkey || '/{item_id}/tags/{tag_id}' else '/types/' || lower(p_type) || '/{item_id}' end as http_path,
    case p_partkey % 4 when 0 then '/parts/' || p_partkey when 1 then '/parts/' || p_partkey || '/{itemID}'
        when 2 then '/parts/' || p_partkey || '/{itemID}/tags/{tagId}'
        else '/types/' || lower(p_type) || case when p_partkey % 2 = p_partkey % 3 then '/{itemID}' else '/{item_id}' end end as raw_path
  from part)"""
SDK = """
sdk as (select k.repo_id, parts.* from (select distinct l_suppkey * 1000000000 + l_partkey // 500 as repo_id, l_partkey as p
    from lineitem where l_returnflag in ('A', 'R')) k join parts using (p))"""
SPEC = """
spec as (select distinct k.repo_id, verb as http_method, http_path, raw_path from (select distinct l_suppkey * 1000000000 + l_partkey // 500 as repo_id, l_partkey as p
    from lineitem where l_returnflag in ('A', 'N')) k join parts using (p))"""
PY_PATH = "case when p % 2 = 0 then 'src/shop/items/raw_client.py' else 'src/shop/items/resources/extra/raw_client.py' end"
PY_CHAIN = "case when p % 2 = 0 then 'items' else 'items.extra' end"
JAVA_PATH = """case when p % 2 = 0 then 'src/main/java/com/shop/resources/stockitems/RawStockItemsClient.java'
    else 'src/main/java/com/shop/resources/stockitems/extra/RawExtraClient.java' end"""
TS_PATH = """case when p % 2 = 0 then 'src/api/resources/items/client/Client.ts'
    else 'src/api/resources/items/resources/extra/client/Client.ts' end"""
FIRST_IN_FILE = "qualify row_number() over (partition by repo_id, path, http_method, http_path order by p) = 1"
BODY_ENTRIES = "case when p % 3 = 0 then 'brandName=brand_name,sizeValue=size_' || size end"
QUERY_ENTRIES = "case when p % 7 = 0 then 'pageSize=page_size,sizeValue=q_size' end"
MERGED_ENTRIES = """case when p % 3 = 0 and p % 7 = 0 then 'brandName=brand_name,pageSize=page_size,sizeValue=q_size'
    when p % 3 = 0 then 'brandName=brand_name,sizeValue=size_' || size when p % 7 = 0 then 'pageSize=page_size,sizeValue=q_size' end"""
WITH_SDK = f"with {PARTS}, {SDK} "


def entries(column):
    """A map as sorted text, which both engines compare alike."""
    pairs = F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.array_join(pairs, ",")


def all_files(spark, sf):
    """Client files of the three languages; a repo's supplier decides which language it is in."""
    language = F.floor(F.col("repo_id") / 1000000000) % 3
    py = corpus.python_files(spark, sf).drop("package_root").filter(language == 0)
    return (py.unionByName(corpus.java_files(spark, sf).filter(language == 1))
            .unionByName(corpus.typescript_files(spark, sf).filter(language == 2)))


@query("source_scan", f"""with {PARTS}, {SDK},
    files as (select distinct repo_id, case repo_id // 1000000000 % 3 when 0 then {PY_PATH} when 1 then {JAVA_PATH} else {TS_PATH} end as path from sdk
      union select distinct repo_id, 'src/main/java/com/shop/' || f as path from sdk, (values ('ShopClient.java'),
        ('resources/stockitems/StockItemsClient.java'), ('resources/stockitems/extra/ExtraClient.java')) w(f) where repo_id // 1000000000 % 3 = 1)
    select repo_id, path, case when path like '%.py' or path like '%/Raw%' or path like '%.ts' then 'raw' else 'wiring' end as role from files""")
def source_scan(spark, sf):
    files = all_files(spark, sf)
    java = java_calls.client_files(files).select("repo_id", "path", "role")
    other = trees.matching(files, rf"{py_calls.FILE_PATTERN}|{ts_calls.FILE_PATTERN}").select("repo_id", "path", F.lit("raw").alias("role"))
    return java.unionByName(other)


def metadata(spark, sf):
    """Generator metadata by supplier; every tenth repo has none, every eleventh an unknown generator."""
    key = F.col("s_suppkey")
    name = F.when(key % 11 == 0, "vendor/ruby-sdk").otherwise(
        F.concat(F.lit("vendor/"), F.get(F.array(*map(F.lit, ["python", "java", "typescript"])), (key % 3).cast("int")), F.lit("-sdk")))
    return corpus.table(spark, sf, "supplier").filter(key % 10 != 0).select(
        key.alias("repo_id"), name.alias("generator_name"), F.concat(F.lit("1."), key).alias("sdk_version"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("c"), key)).alias("origin_commit"))


def languages(spark, sf):
    suppliers = corpus.table(spark, sf, "supplier")
    overrides = suppliers.filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("repo_id"), F.lit("java").alias("language"))
    return repo.repo_languages(suppliers.select(F.col("s_suppkey").alias("repo_id")), metadata(spark, sf), overrides)


LANGUAGE_SQL = """languages as (select s_suppkey as repo_id,
    case when s_suppkey % 20 = 0 then 'java' when s_suppkey % 10 = 0 or s_suppkey % 11 = 0 then null
         when s_suppkey % 3 = 0 then 'python' when s_suppkey % 3 = 1 then 'java' else 'typescript' end as language from supplier)"""


@query("repo_language", f"""with {LANGUAGE_SQL}
    select repo_id, language,
      case when repo_id % 20 = 0 then 'java-sdk' when repo_id % 10 = 0 then null when repo_id % 11 = 0 then 'vendor/ruby-sdk' else 'vendor/' || language || '-sdk' end as generator_name,
      case when repo_id % 10 = 0 then 'unknown' else '1.' || repo_id end as sdk_version,
      case when repo_id % 10 = 0 then 'unknown' when repo_id % 7 = 0 then '' else 'c' || repo_id end as origin_commit,
      case when repo_id % 20 = 0 then 'ok' when repo_id % 10 = 0 then 'no_metadata' when repo_id % 11 = 0 then 'unsupported_generator' else 'ok' end as status
    from languages""")
def repo_language(spark, sf):
    return languages(spark, sf)


def repo_files(spark, sf):
    """Manifest and contract files of each supplier's repo."""
    key = F.col("s_suppkey")
    file = lambda path, content, when: F.when(when, F.struct(F.lit(path).alias("path"), content.alias("content")))
    package = F.concat(F.lit("pkg"), key)
    rows = F.array_compact(F.array(
        file("package.json", F.concat(F.lit('{"version": "1", "name": "@shop/'), package, F.lit('"}')), key % 5 != 0),
        file("pyproject.toml", F.concat(F.lit('[tool]\nname = "'), package, F.lit('"\nname = "second"\n')), key % 4 != 0),
        file("build.gradle", F.concat(F.lit("group = 'com."), package, F.when(key % 2 == 0, "'\n").otherwise("'\n  artifactId = \"core\"\n")), key % 7 != 0),
        file("src/_hidden/a.py", F.lit(""), key >= 0), file("src/shop/a.py", F.lit(""), key % 2 == 0), file("src/zoo/a.py", F.lit(""), key >= 0),
        file("src/shop/openapi/openapi.json", F.lit("{}"), key % 2 == 0), file("src/main/resources/openapi/openapi.json", F.lit("{}"), ((key % 3 == 1) | (key % 20 == 0)) & (key % 8 != 0)),
        file("openapi/openapi.json", F.lit("{}"), key % 9 != 0)))
    return corpus.table(spark, sf, "supplier").select(key.alias("repo_id"), F.inline(rows))


@query("package_name", f"""with {LANGUAGE_SQL}
    select repo_id, language, case
      when language = 'typescript' and repo_id % 5 <> 0 then '@shop/pkg' || repo_id
      when language = 'python' and repo_id % 4 <> 0 then 'pkg' || repo_id
      when language = 'java' and repo_id % 7 <> 0 then 'com.pkg' || repo_id || case when repo_id % 2 = 0 then '' else ':core' end
      else 'unknown' end as package_name from languages where language is not null""")
def package_name(spark, sf):
    return repo.package_names(languages(spark, sf).filter("language is not null"), repo_files(spark, sf))


@query("spec_location", f"""with {LANGUAGE_SQL}
    select repo_id, case when repo_id % 13 = 0 then 'given.json'
      when language = 'python' and repo_id % 2 = 0 then 'src/shop/openapi/openapi.json'
      when language = 'java' and repo_id % 8 <> 0 then 'src/main/resources/openapi/openapi.json'
      when language is not null and repo_id % 9 <> 0 then 'openapi/openapi.json' end as spec_path from languages""")
def spec_location(spark, sf):
    overrides = corpus.table(spark, sf, "supplier").filter("s_suppkey % 13 = 0").select(
        F.col("s_suppkey").alias("repo_id"), F.lit("given.json").alias("spec_path"))
    return repo.spec_locations(languages(spark, sf), repo_files(spark, sf), overrides)


@query("changed_artifacts", """select p_partkey as artifact, case when p_partkey % 7 = 0 then 'deleted'
      when p_partkey % 13 = 0 then 'inserted' when p_partkey % 11 = 0 then 'updated' else 'unchanged' end as change
    from part where p_partkey % 17 <> 0 and not (p_partkey % 7 = 0 and p_partkey % 13 = 0)""")
def changed_artifacts(spark, sf):
    part, key = corpus.table(spark, sf, "part"), F.col("p_partkey")
    payload = lambda size: F.to_json(F.struct(F.col("p_name"), size.alias("p_size")))
    stored = artifacts.with_digest(part.filter(key % 13 != 0).select(key.alias("artifact"), payload(F.col("p_size")).alias("payload")))
    current = artifacts.with_digest(part.filter(key % 7 != 0).select(
        key.alias("artifact"), payload(F.when(key % 11 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("payload")))
    return artifacts.changes(current, stored, ["artifact"], part.filter(key % 17 != 0).select(key.alias("artifact")))


def python_calls(spark, sf):
    return py_calls.call_spans(py_calls.method_pieces(corpus.python_files(spark, sf)))


@query("py_endpoints", f"""{WITH_SDK}
    select repo_id, path, http_method, http_path, chain || '.op_' || p as method_chain, 'op_' || p as method_name, kwargs as body_kwargs, passthrough from (
      select *, verb as http_method, {PY_PATH} as path, {PY_CHAIN} as chain, {MERGED_ENTRIES} as kwargs,
             case when p % 3 = 1 then 'request' end as passthrough from sdk) {FIRST_IN_FILE}""")
def py_endpoints(spark, sf):
    return py_calls.python_endpoints(corpus.python_files(spark, sf)).select(
        "repo_id", "path", "http_method", "http_path", F.array_join("method_chain", ".").alias("method_chain"), "method_name",
        entries(F.col("body_kwarg_by_json_key")).alias("body_kwargs"), F.col("body_kwarg_for_passthrough").alias("passthrough"))


@query("py_call_spans", f"""{WITH_SDK}
    select repo_id, {PY_PATH} as path, 'op_' || p as method_name,
      '        _response = self._client_wrapper.httpx_client.' || case when p % 11 = 0 then 'stream' else 'request' end || '(' || chr(10) || '            '
      || case p % 4 when 0 then '"parts/' || p || '"' when 1 then 'f"parts/' || p || '/{{jsonable_encoder(item_id)}}"'
           when 2 then 'f"parts/' || p || '/{{jsonable_encoder(item_id)}}/tags/{{jsonable_encoder(tag_id)}}"' else 'f"types/' || kind || '/{{jsonable_encoder(item_id)}}"' end
      || ',' || chr(10) || '            method="' || verb || '",' || chr(10)
      || case p % 3 when 0 then '            json={{"sizeValue": size_' || size || ', "brandName": jsonable_encoder(convert(brand_name)), "mixed": f(a, b)}},' || chr(10)
           when 1 then '            json=jsonable_encoder(request),' || chr(10) else '' end
      || case when p % 7 = 0 then '            params={{"pageSize": page_size, "sizeValue": q_size}},' || chr(10) else '' end
      || '            headers={{"X-Trace": str(trace("' || p || '"))}},' || chr(10) || '        )' as call_text from sdk""")
def py_call_spans(spark, sf):
    return python_calls(spark, sf).select("repo_id", "path", "method_name", "call_text")


@query("py_path_verb", f"{WITH_SDK} select repo_id, {PY_PATH} as path, 'op_' || p as method_name, verb as http_method, http_path from sdk")
def py_path_verb(spark, sf):
    return py_calls.calls_with_targets(python_calls(spark, sf)).select("repo_id", "path", "method_name", "http_method", "http_path")


@query("py_path_params", f"""{WITH_SDK} select repo_id, {PY_PATH} as path, 'op_' || p as method_name,
    case p % 4 when 0 then '' when 2 then 'item_id,tag_id' else 'item_id' end as path_params from sdk""")
def py_path_params(spark, sf):
    names = py_calls.path_parameter_names(py_calls.request_path(F.col("call_text")))
    return python_calls(spark, sf).select("repo_id", "path", "method_name", F.array_join(names, ",").alias("path_params"))


@query("py_body_args", f"""{WITH_SDK} select repo_id, {PY_PATH} as path, 'op_' || p as method_name,
    {BODY_ENTRIES} as body_kwargs, case when p % 3 = 1 then 'request' end as body_passthrough from sdk""")
def py_body_args(spark, sf):
    return py_calls.body_arguments(python_calls(spark, sf)).select(
        "repo_id", "path", "method_name", entries(F.col("body_kwargs")).alias("body_kwargs"), "body_passthrough")


@query("py_query_args", f"""{WITH_SDK} select repo_id, {PY_PATH} as path, 'op_' || p as method_name,
    {QUERY_ENTRIES} as query_kwargs, {MERGED_ENTRIES} as merged_kwargs from sdk""")
def py_query_args(spark, sf):
    calls = py_calls.merge_arguments(py_calls.query_arguments(py_calls.body_arguments(python_calls(spark, sf))))
    return calls.select("repo_id", "path", "method_name", entries(F.col("query_kwargs")).alias("query_kwargs"),
                        entries(F.col("merged_kwargs")).alias("merged_kwargs"))


@query("py_chain", f"{WITH_SDK} select distinct repo_id, {PY_PATH} as path, {PY_CHAIN} as chain from sdk")
def py_chain(spark, sf):
    chain = py_calls.method_chain(F.col("path"), F.col("package_root"))
    return corpus.python_files(spark, sf).select("repo_id", "path", F.array_join(chain, ".").alias("chain"))


@query("dedupe_first", f"""{WITH_SDK} select repo_id, path, http_method, http_path, p as ord
    from (select *, verb as http_method, {PY_PATH} as path from sdk) {FIRST_IN_FILE}""")
def dedupe_first(spark, sf):
    calls = corpus.sdk_side(spark, sf).select(
        "repo_id", F.when(F.col("p") % 2 == 0, "src/shop/items/raw_client.py").otherwise("src/shop/items/resources/extra/raw_client.py").alias("path"),
        F.upper("verb").alias("http_method"), F.concat(F.lit("/"), "call_path").alias("http_path"), F.col("p").alias("ord"))
    return py_calls.first_per_file(calls)


@query("java_endpoints", f"""{WITH_SDK}
    select repo_id, path, http_method, http_path, case when p % 2 = 0 then 'stockItems' else 'stockItems.more' end || '.op' || p as method_chain,
      'op' || p as method_name, case p % 6 when 0 then 'Op' || p || 'Request' when 3 then 'Op' || p || 'Request' when 5 then 'Page' end as request_class
    from (select *, verb as http_method, {JAVA_PATH} as path from sdk) {FIRST_IN_FILE}""")
def java_endpoints(spark, sf):
    return java_calls.java_endpoints(corpus.java_files(spark, sf)).select(
        "repo_id", "path", "http_method", "http_path", F.array_join("method_chain", ".").alias("method_chain"), "method_name",
        F.col("request_class_name").alias("request_class"))


@query("java_paths", f"{WITH_SDK} select repo_id, {JAVA_PATH} as path, 'op' || p as method_name, verb as http_method, http_path from sdk")
def java_paths(spark, sf):
    return (java_calls.method_calls(java_calls.java_methods(corpus.java_files(spark, sf)))
            .select("repo_id", "path", "method_name", "http_method", "http_path"))


@query("java_request_class", f"""{WITH_SDK} select repo_id, {JAVA_PATH} as path, 'op' || p as method_name,
    case p % 6 when 0 then 'Op' || p || 'Request' when 3 then 'Op' || p || 'Request' when 5 then 'Page' end as request_class
    from sdk, (values (0), (1)) overload(n)""")
def java_request_class(spark, sf):
    return java_calls.java_methods(corpus.java_files(spark, sf)).select(
        "repo_id", "path", "method_name", java_calls.request_class(F.col("param_list")).alias("request_class"))


@query("java_accessors", f"""{WITH_SDK} select distinct repo_id, 'src/main/java/com/shop/resources/' || d as dir, a as accessor
    from sdk, (values ('stockitems', 'stockItems'), ('stockitems/extra', 'more')) w(d, a)""")
def java_accessors(spark, sf):
    return java_calls.accessors(corpus.java_files(spark, sf))


@query("java_chain", f"""{WITH_SDK} select distinct repo_id, regexp_replace({JAVA_PATH}, '/[^/]*$', '') as dir,
    case when p % 2 = 0 then 'stockItems' else 'stockItems.more' end as chain from sdk
    qualify count(*) filter (where p % 2 = 0) over (partition by repo_id) > 0""")
def java_chain(spark, sf):
    files = corpus.java_files(spark, sf)
    raw = java_calls.client_files(files).filter("role = 'raw'")
    return (java_calls.method_chains(raw, java_calls.accessors(files))
            .select("repo_id", "dir", F.array_join("chain", ".").alias("chain")))


@query("ts_endpoints", f"""{WITH_SDK} select repo_id, {TS_PATH} as path, verb as http_method, http_path,
    case when p % 2 = 0 then 'items' else 'items.extra' end || '.op' || p as method_chain, 'op' || p as method_name,
    case p % 6 when 1 then 'payload' when 3 then '_body' when 5 then 'the-body' end as wrapper_key from sdk""")
def ts_endpoints(spark, sf):
    return ts_calls.typescript_endpoints(corpus.typescript_files(spark, sf)).select(
        "repo_id", "path", "http_method", "http_path", F.array_join("method_chain", ".").alias("method_chain"), "method_name",
        F.col("body_wrapper_key").alias("wrapper_key"))


@query("ts_url_path", """select page_id, nullif(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '^\\{[^}]+\\}', ''), '') as url_path from pages""")
def ts_url_path(spark, sf):
    quoted = F.concat(F.lit('"'), F.col("url"), F.lit('",'))
    return corpus.table(spark, sf, "pages").select("page_id", ts_calls.url_path(quoted).alias("url_path"))


@query("ts_wrapper_key", f"""{WITH_SDK} select repo_id, {TS_PATH} as path, 'op' || p as method_name,
    case p % 6 when 0 then 'request' when 4 then null else '_body' end as body_ident,
    case p % 6 when 1 then 'payload' when 3 then '_body' when 5 then 'the-body' end as wrapper_key from sdk""")
def ts_wrapper_key(spark, sf):
    calls = ts_calls.method_calls(ts_calls.method_bodies(corpus.typescript_files(spark, sf)))
    return calls.select("repo_id", "path", "method_name", "body_ident",
                        ts_calls.wrapper_key(F.col("body"), F.col("body_ident")).alias("wrapper_key"))


@query("ts_chain", f"""{WITH_SDK} select distinct repo_id, {TS_PATH} as path, case when p % 2 = 0 then 'items' else 'items.extra' end as chain from sdk""")
def ts_chain(spark, sf):
    return corpus.typescript_files(spark, sf).select(
        "repo_id", "path", F.array_join(ts_calls.method_chain(F.col("path")), ".").alias("chain"))


@query("extraction_status", f"""with {PARTS}, {SDK}
    select repo_id, client_files, case when repo_id // 1000000000 % 4 = 1 then 0 else endpoints end as endpoints,
      case when repo_id // 1000000000 % 4 = 1 then 'no_endpoints' else 'ok' end as status from (
      select repo_id, count(distinct p % 2) as client_files, count(distinct {PY_PATH} || verb || http_path) as endpoints from sdk group by repo_id)""")
def extraction_status_query(spark, sf):
    files = corpus.python_files(spark, sf)
    drifted = F.floor(F.col("repo_id") / 1000000000) % 4 == 1
    changed = files.withColumn("content", F.when(drifted, F.replace("content", F.lit("httpx_client"), F.lit("http"))).otherwise(F.col("content")))
    listing = files.select("repo_id", F.rlike("path", F.lit(py_calls.FILE_PATTERN)).alias("is_client"))
    return extraction_status(listing, py_calls.python_endpoints(changed))


@query("path_norm", """select page_id, case when length(r) > 1 and r like '%/' then left(r, length(r) - 1) else r end as path from (
    select page_id, case when s like '/%' then s else '/' || s end as r from (
      select page_id, replace(regexp_replace(url, '^https?://', ''), '/en/', '/') || case when page_id % 2 = 0 then '/' else '' end as s from pages))""")
def path_norm(spark, sf):
    raw = F.concat(F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/en/"), F.lit("\\")), F.when(F.col("page_id") % 2 == 0, "/").otherwise(""))
    return corpus.table(spark, sf, "pages").select("page_id", tx.normalize_path(raw).alias("path"))


@query("placeholder_norm", """select p_partkey, '/{user_id}/' || replace(p_name, ' ', '-') || '/{HTTP}/{html_parser' || p_size || 'x_y}/{a-B}' as http_path from part"""
       .replace("{HTTP}", "{http}"))
def placeholder_norm(spark, sf):
    raw = F.concat(F.lit("/{userID}/"), F.translate("p_name", " ", "-"), F.lit("/{HTTP}/{HTMLParser"), F.col("p_size").cast("string"), F.lit("xY}/{a-B}"))
    return corpus.table(spark, sf, "part").select("p_partkey", tx.normalize_placeholders(raw).alias("http_path"))


@query("case_conv", """with w as (select p_partkey, replace(p_name, ' ', '_') as s, string_split(p_name, ' ') as words, p_size from part)
    select p_partkey, 'my' || p_size || '_' || s as snake,
      'x' || list_reduce(list_prepend('', list_transform(words, lambda v: upper(left(v, 1)) || substr(v, 2))), lambda a, b: a || b) || p_size as camel,
      'Q' || list_reduce(list_prepend('', list_transform(words, lambda v: upper(left(v, 1)) || substr(v, 2))), lambda a, b: a || b) as pascal,
      upper(s) || '_' || p_size as screaming from w""")
def case_conv(spark, sf):
    name = F.col("p_name")
    capital = F.array_join(F.transform(F.split(name, " "), lambda w: F.initcap(w)), "")
    return corpus.table(spark, sf, "part").select(
        "p_partkey", tx.camel_to_snake(F.concat(F.lit("my"), F.col("p_size").cast("string"), capital)).alias("snake"),
        tx.snake_to_camel(F.concat(F.lit("x_"), F.translate(name, " ", "_"), F.lit("_"), F.col("p_size").cast("string"))).alias("camel"),
        tx.pascal_case(F.concat(F.lit("q-"), F.translate(name, " ", "-"))).alias("pascal"),
        tx.screaming_snake(F.concat(F.translate(name, " ", "-"), F.lit("-"), F.col("p_size").cast("string"))).alias("screaming"))


@query("strip_prefix", """select p_partkey, case p_partkey % 4 when 0 then 'Size' || p_size when 1 then null when 2 then lower(p_type) || '_item'
    else 'Item_' || p_size end as class_name from part""")
def strip_prefix(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = F.lower("p_type")
    name = (F.when(key % 4 == 0, F.concat(kind, F.lit("_group_Size"), size)).when(key % 4 == 1, F.concat(kind, F.lit("_Size_Role"), size))
            .when(key % 4 == 2, F.concat(kind, F.lit("_item"))).otherwise(F.concat(F.lit("Item_"), size)))
    return corpus.table(spark, sf, "part").select("p_partkey", tx.strip_schema_prefix(name).alias("class_name"))
