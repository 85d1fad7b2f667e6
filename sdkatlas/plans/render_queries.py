"""Queries over resolved schemas and render schemas, on the contract corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sdkatlas.operators import calltext, contract, match, render, schema, values
from sdkatlas.functions.rows import joined
from sdkatlas.plans import corpus, manifest
from sdkatlas.plans.contract_queries import OPS
from sdkatlas.plans.registry import query
from sdkatlas.session import checkpointed
from sdkatlas.plans.source_queries import entries

KEY = ["repo_id", "http_method", "http_path"]

# Resolved nodes of each body and field root, for the SQL side: who, place, order, type, enum, required, name.
# The groups say for which parts a row holds: c = p % 6.
NODES = f"""{OPS}, shapes(c, path, slot, ord, type, enum, required, ref_name) as (values
    (1, '', 'root', 1, 'object', null, 'name,sku', 'item_Part#'), (1, '/properties/note_text', 'properties', 1, 'string', null, null, null),
    (1, '/properties/name', 'properties', 2, 'string', null, null, null), (1, '/properties/sku', 'properties', 3, null, '@,7', null, null),
    (1, '/properties/role', 'properties', 4, 'string', 'user,assistant,sys-tem', null, 'item_Role'), (1, '/properties/mode', 'properties', 5, 'string', 'on,off', null, 'item_Part_Mode'),
    (1, '/properties/tags', 'properties', 6, 'array', null, null, null), (1, '/properties/parent', 'properties', 7, null, null, null, 'item_Part#'),
    (1, '/properties/tags/items', 'items', 1, 'object', null, 'label', 'item_Tag'), (1, '/properties/tags/items/properties/weight', 'properties', 1, 'number', null, null, null),
    (1, '/properties/tags/items/properties/label', 'properties', 2, 'string', null, null, null), (1, '/properties/tags/items/properties/next', 'properties', 3, null, null, null, 'item_Tag'),
    (2, '', 'root', 1, 'object', null, 'size,size', null), (2, '/properties/owner', 'properties', 1, 'object', null, 'label', 'item_Tag'),
    (2, '/properties/owner/properties/weight', 'properties', 1, 'number', null, null, null), (2, '/properties/owner/properties/label', 'properties', 2, 'string', null, null, null),
    (2, '/properties/owner/properties/next', 'properties', 3, null, null, null, 'item_Tag'), (2, '/properties/size', 'properties', 2, 'integer', null, null, null),
    (2, '/properties/extra', 'properties', 3, 'object', null, null, null), (2, '/properties/extra/properties/deep', 'properties', 1, 'string', null, null, null),
    (3, '', 'root', 1, 'array', null, null, null), (3, '/items', 'items', 1, 'object', null, 'label', 'item_Tag'), (3, '/items/properties/weight', 'properties', 1, 'number', null, null, null),
    (3, '/items/properties/label', 'properties', 2, 'string', null, null, null), (3, '/items/properties/next', 'properties', 3, null, null, null, 'item_Tag'),
    (4, '', 'root', 1, 'object', null, 'created_by,label', 'item_Part#'), (4, '/properties/created_by', 'properties', 1, 'number', null, null, null),
    (4, '/properties/audit_note', 'properties', 2, 'boolean', null, null, null), (4, '/properties/label', 'properties', 3, 'string', null, null, null),
    (5, '', 'root', 1, null, null, null, null), (5, '/oneOf/0', 'oneOf', 1, 'object', null, 'label', 'item_Tag'), (5, '/oneOf/1', 'oneOf', 2, 'string', null, null, null),
    (5, '/oneOf/0/properties/weight', 'properties', 1, 'number', null, null, null), (5, '/oneOf/0/properties/label', 'properties', 2, 'string', null, null, null),
    (5, '/oneOf/0/properties/next', 'properties', 3, null, null, null, 'item_Tag')),
  nodes as (select ops.*, path, slot, ord, type, replace(enum, '@', cast(size as varchar)) as enum, required, replace(ref_name, '#', cast(p as varchar)) as ref_name
    from ops join shapes on c = p % 6)"""


def contract_body_nodes(spark, sf, only=None):
    """Resolved nodes of each operation's body, keyed by the operation."""
    docs = checkpointed(corpus.contract_documents(spark, sf))  # the corpus is written out once
    ends = contract.endpoints(docs).withColumn("root_id", schema.root_id(F.lit("body"), F.col("body_schema")))
    ends = checkpointed((ends.filter(only) if only is not None else ends).select(*KEY, "root_id", "body_schema").filter("body_schema is not null"))
    roots = schema.roots_of(ends.select("repo_id", F.lit("body").alias("usage"), F.col("body_schema").alias("text")))
    nodes = schema.resolve(roots, contract.components(docs))
    place = Window.partitionBy("repo_id", "root_id", "parent_path", "slot").orderBy("ord")
    return joined(ends.drop("body_schema"), nodes.withColumn("ord", F.row_number().over(place)), ["repo_id", "root_id"])


def _node_columns(rows):
    return rows.select(*KEY, "path", "slot", "ord", "type", F.array_join("enum", ",").alias("enum"), F.array_join("required", ",").alias("required"), "ref_name")


@query("schema_resolve", f"with {NODES} select repo_id, http_method, http_path, path, slot, ord, type, enum, required, ref_name from nodes")
def schema_resolve(spark, sf):
    return _node_columns(contract_body_nodes(spark, sf))


@query("allof_flatten", f"with {NODES} select repo_id, http_method, http_path, path, slot, ord, type, enum, required, ref_name from nodes where p % 6 = 4")
def allof_flatten(spark, sf):
    docs = corpus.contract_documents(spark, sf)
    combined = F.contains("text", F.lit('"allOf"'))
    named = contract.components(docs).filter(combined).select("repo_id", F.concat(F.lit('{"$ref": "#/components/schemas/'), "name", F.lit('"}')).alias("text"), "name")
    roots = schema.roots_of(named.select("repo_id", F.lit("body").alias("usage"), "text"))
    nodes = schema.resolve(roots, contract.components(docs))
    place = Window.partitionBy("repo_id", "root_id", "parent_path", "slot").orderBy("ord")
    part = F.regexp_extract("name", r"(\d+)$", 1).cast("bigint")
    ops = named.select("repo_id", schema.root_id(F.lit("body"), F.col("text")).alias("root_id"), part.alias("p"))
    verbs = F.upper(F.get(F.array(*map(F.lit, corpus.VERBS)), (F.col("p") % 5).cast("int")))
    rows = ops.join(nodes.withColumn("ord", F.row_number().over(place)), ["repo_id", "root_id"])
    return _node_columns(rows.withColumn("http_method", verbs).withColumn("http_path", corpus.text("/parts/<p>/{tag_id}/x/{item_id}", p=F.col("p"))))


def prepared(spark, sf):
    """Matched endpoints with their language, and the resolved nodes of their schemas."""
    docs = checkpointed(corpus.contract_documents(spark, sf))
    languages = corpus.contract_languages(spark, sf)
    ends = checkpointed(contract.endpoints(docs))
    rows = joined(match.matched(ends, match.mapping_index(corpus.contract_mappings(spark, sf))), languages, "repo_id")
    return rows, render.resolved_nodes(ends, contract.components(docs), languages)


def shaped(spark, sf):
    rows, nodes = prepared(spark, sf)
    return render.with_shape(rows, render.root_kinds(nodes)), nodes


@query("params_url_order", f"""with {OPS} select repo_id, http_method, http_path, 'tagId:enum,itemID:string' as params from ops""")
def params_url_order(spark, sf):
    rows, nodes = prepared(spark, sf)
    text = F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["kind"])), ",")
    return render.with_params(rows, render.root_kinds(nodes)).select(*KEY, text.alias("params"))


KIND = "case when enum is not null then 'enum' when type in ('integer', 'number') then 'number' when type = 'array' then 'list' when type in ('string', 'boolean') then type else 'object' end"


@query("field_kind", f"with {NODES} select repo_id, http_method, http_path, path, {KIND} as kind from nodes")
def field_kind(spark, sf):
    return contract_body_nodes(spark, sf).select(*KEY, "path", render.infer_kind(F.col("type"), F.col("enum")).alias("kind"))


# Fields an endpoint offers: order, key, kind, required; c = p % 6.
FIELDS = f"""{OPS}, listed(c, ord, json_key, kind, required) as (values
    (1, 1, 'name', 'string', true), (1, 2, 'sku', 'enum', true), (1, 3, 'note_text', 'string', false), (1, 4, 'role', 'enum', false), (1, 5, 'mode', 'enum', false),
    (1, 6, 'tags', 'list', false), (1, 7, 'parent', 'object', false), (2, 1, 'size', 'number', true), (2, 2, 'size', 'number', true), (2, 3, 'owner', 'object', false),
    (2, 4, 'extra', 'object', false), (3, 1, '', 'list', true), (4, 1, 'created_by', 'number', true), (4, 2, 'label', 'string', true), (4, 3, 'audit_note', 'boolean', false),
    (5, 1, '', 'object', true)),
  offered as (select ops.*, 0 as part, ord, json_key, kind, required from ops join listed on c = p % 6
    union all select ops.*, 1, 1, 'page_size', case when p % 3 = 0 then 'number' else 'string' end, p % 3 <> 0 from ops
      where p % 6 not in (3, 5) and not (language = 'typescript' and p % 7 = 0))"""
TEMPLATE = """case when json_key = '' then '{{value}}' when language = 'python' then case json_key when 'name' then 'name_' when 'page_size' then 'limit' else json_key end || '={{value}}'
    when language = 'typescript' then '"' || json_key || '": {{value}}'
    else '.' || case json_key when 'note_text' then 'noteText' when 'created_by' then 'createdBy' when 'audit_note' then 'auditNote' when 'page_size' then 'pageSize' else json_key end || '({{value}})' end"""


def offered(spark, sf):
    rows, nodes = shaped(spark, sf)
    fields = render.top_fields(rows, render.catalog(nodes))
    place = Window.partitionBy(*KEY, "part").orderBy("group", "ord")
    return fields.withColumn("ord", F.row_number().over(place))


@query("body_fields", f"with {FIELDS} select repo_id, http_method, http_path, ord, json_key, kind, required from offered where part = 0")
def body_fields(spark, sf):
    return offered(spark, sf).filter("part = 0").select(*KEY, "ord", "json_key", "kind", "required")


@query("field_templates", f"with {FIELDS} select repo_id, http_method, http_path, part, ord, json_key, {TEMPLATE} as field_template from offered")
def field_templates(spark, sf):
    return offered(spark, sf).select(*KEY, "part", "ord", "json_key", "field_template")


@query("enum_constants", f"""with {FIELDS} select repo_id, http_method, http_path, json_key,
    case json_key when 'sku' then size || ',7' when 'mode' then 'on,off' else 'user,assistant,sys-tem' end as enum_values,
    case when json_key <> 'role' or language = 'python' then null when language = 'java' then 'assistant=Role.ASSISTANT,sys-tem=Role.SYS_TEM,user=Role.USER'
      else 'assistant=Role.Assistant,sys-tem=Role.SysTem,user=Role.User' end as enum_constants from offered where kind = 'enum'""")
def enum_constants(spark, sf):
    return offered(spark, sf).filter("kind = 'enum'").select(
        *KEY, "json_key", F.array_join("enum_values", ",").alias("enum_values"), entries(F.col("enum_constants")).alias("enum_constants"))


@query("nested_fields", f"""with {OPS}, below(c, path, json_key, kind, required, langs) as (values
    (1, '/properties/tags/items', '', 'object', true, 'pjt'), (3, '/items', '', 'object', true, 'pjt'),
    (1, '/properties/tags/items/properties/label', 'label', 'string', true, 'jt'), (1, '/properties/tags/items/properties/weight', 'weight', 'number', false, 'jt'),
    (1, '/properties/tags/items/properties/next', 'next', 'object', false, 'jt'), (2, '/properties/owner/properties/label', 'label', 'string', true, 'jt'),
    (2, '/properties/owner/properties/weight', 'weight', 'number', false, 'jt'), (2, '/properties/owner/properties/next', 'next', 'object', false, 'jt'),
    (3, '/items/properties/label', 'label', 'string', true, 'jt'), (3, '/items/properties/weight', 'weight', 'number', false, 'jt'), (3, '/items/properties/next', 'next', 'object', false, 'jt'))
    select repo_id, http_method, http_path, path, json_key, kind, required, case when json_key <> '' or language = 'python' then null
      when language = 'java' then 'Tag.builder(){{{{__body__}}}}.build()' else '{{ {{{{__body__}}}} }}' end as wrap
    from ops join below on c = p % 6 and contains(langs, left(language, 1))""")
def nested_fields(spark, sf):
    rows, nodes = shaped(spark, sf)
    below = render.catalog(nodes).filter(~render.is_top() & (F.col("usage") == "body")).select(
        "repo_id", F.col("root_id").alias("body_root"), "path", "json_key", "kind", "required", "wrap")
    return joined(rows.select(*KEY, "body_root"), below, ["repo_id", "body_root"]).drop("body_root")


@query("passthrough", f"""with {OPS} select repo_id, http_method, http_path, case when p % 6 = 3 then 'list' else 'object' end as kind, '{{{{value}}}}' as field_template
    from ops where p % 6 in (3, 5)""")
def passthrough(spark, sf):
    return offered(spark, sf).filter("passthrough").select(*KEY, "kind", "field_template")


QUERY_DROPPED = "(p % 6 in (3, 5) or (language = 'typescript' and p % 7 = 0))"


@query("query_fold", f"""with {OPS} select repo_id, http_method, http_path, not {QUERY_DROPPED} as folds_query, case when {QUERY_DROPPED} then
    case when language = 'typescript' and p % 7 = 0 then 'query_dropped_wrapped_body' else 'query_dropped_passthrough_body' end end as warning from ops""")
def query_fold(spark, sf):
    rows, _ = shaped(spark, sf)
    dropped = render.warnings(rows).filter(F.col("warning").startswith("query_"))
    return joined(rows.select(*KEY, "folds_query"), dropped.select(*KEY, "warning"), KEY, "left")


@query("java_unrenderable", f"""with {OPS} select repo_id, http_method, http_path, language = 'java' and p % 6 not in (3, 5) and p % 4 = 0 as java_unrenderable from ops""")
def java_unrenderable(spark, sf):
    return shaped(spark, sf)[0].select(*KEY, "java_unrenderable")


BODY_SLOT = """case when language = 'java' and p % 6 not in (3, 5) and p % 4 = 0 then null
    when language = 'typescript' and p % 7 = 0 and p % 6 = 0 then null
    when language = 'python' and p % 6 in (3, 5) then case when p % 2 = 0 then 'payload' else 'request' end || '={{__body__}}'
    when language = 'typescript' then case when p % 7 = 0 then '{ "body": ' else '' end || case when p % 6 in (3, 5) then '{{__body__}}' else '{ {{__body__}} }' end
      || case when p % 7 = 0 then ' }' else '' end
    when p % 6 in (3, 5) or language = 'python' then '{{__body__}}' else 'Op' || p || 'Request.builder(){{__body__}}.build()' end"""


@query("body_slot", f"with {OPS} select repo_id, http_method, http_path, {BODY_SLOT} as body_slot from ops")
def body_slot(spark, sf):
    return shaped(spark, sf)[0].select(*KEY, render.body_slot().alias("body_slot"))


CALL_HEAD = """'client.' || case when language = 'java' then 'shop().items()' else 'shop.items' end || '.op' || p || '('
    || case when language <> 'python' then '{{tagId}}, {{itemID}}' when p % 2 = 0 then 'tag_id={{tagId}}, item={{itemID}}' else 'tagId={{tagId}}, itemID={{itemID}}' end"""
CALL_TEMPLATE = f"{CALL_HEAD} || coalesce(', ' || {BODY_SLOT}, '') || ')'"


@query("call_template", f"with {OPS} select repo_id, http_method, http_path, {CALL_TEMPLATE} as call_template from ops")
def call_template(spark, sf):
    rows, nodes = shaped(spark, sf)
    return render.with_call_template(rows, render.root_kinds(nodes)).select(*KEY, "call_template")


@query("render_rules", """select language, r.* from (select distinct case s_suppkey % 3 when 0 then 'python' when 1 then 'java' else 'typescript' end as language from supplier),
    lateral (select '"{{value}}"' as "stringLiteral", '{{value}}' as "numberLiteral", case when language = 'python' then 'True' else 'true' end as "trueLiteral",
      case when language = 'python' then 'False' else 'false' end as "falseLiteral", case when language = 'python' then 'None' else 'null' end as "nullLiteral",
      case when language = 'java' then 'Arrays.asList({{items}})' else '[{{items}}]' end as "listLiteral", ', ' as "listSeparator") r""")
def render_rules(spark, sf):
    used = corpus.table(spark, sf, "supplier").select(
        F.get(F.array(*map(F.lit, ["python", "java", "typescript"])), (F.col("s_suppkey") % 3).cast("int")).alias("language")).distinct()
    return used.join(F.broadcast(render.render_rules(spark)), "language")


FIELD_JSON = f"""'{{"jsonKey":"' || json_key || '","fieldTemplate":"' || replace({TEMPLATE}, '"', '\\"') || '","kind":"' || kind || '","required":' || required
    || case when json_key = '' then ',"passthroughBody":true' else '' end
    || case when kind <> 'enum' then '' when json_key = 'sku' then ',"enumValues":["' || size || '","7"]' when json_key = 'mode' then ',"enumValues":["on","off"]'
        else ',"enumValues":["user","assistant","sys-tem"]' || case language when 'python' then '' when 'java' then ',"enumConstants":{{"user":"Role.USER","assistant":"Role.ASSISTANT","sys-tem":"Role.SYS_TEM"}}'
          else ',"enumConstants":{{"user":"Role.User","assistant":"Role.Assistant","sys-tem":"Role.SysTem"}}' end end
    || case when kind = 'list' then ',"items":{{"jsonKey":"","fieldTemplate":"{{{{value}}}}","kind":"object","required":true' || nested || '}}' when json_key = 'owner' then nested else '' end || '}}'"""
FIELD_JSON = FIELD_JSON.replace("{{{{value}}}}", "{{value}}").replace(":{{", ":{").replace('"}}', '"}').replace("'}}'", "'}'")
NESTED = """case language when 'python' then '' when 'java' then ',"nested":{"fieldSeparator":"","fields":[{"jsonKey":"label","fieldTemplate":".label({{value}})","kind":"string","required":true},{"jsonKey":"weight","fieldTemplate":".weight({{value}})","kind":"number","required":false},{"jsonKey":"next","fieldTemplate":".next({{value}})","kind":"object","required":false}],"wrap":"Tag.builder(){{__body__}}.build()"}'
    else ',"nested":{"fieldSeparator":", ","fields":[{"jsonKey":"label","fieldTemplate":"\\"label\\": {{value}}","kind":"string","required":true},{"jsonKey":"weight","fieldTemplate":"\\"weight\\": {{value}}","kind":"number","required":false},{"jsonKey":"next","fieldTemplate":"\\"next\\": {{value}}","kind":"object","required":false}],"wrap":"{ {{__body__}} }"}' end"""
RENDER = f"""field_rows as (select repo_id, http_method, http_path, p, language, string_agg({FIELD_JSON}, ',' order by part, ord) as fields
      from (select *, {NESTED} as nested from offered) group by all),
    renders as (select ops.*, '{{"callTemplate":"' || replace({CALL_TEMPLATE}, '"', '\\"') || '","params":[{{"name":"tagId","kind":"enum"}},{{"name":"itemID","kind":"string"}}]'
      || coalesce(',"body":{{"fieldSeparator":"' || case when ops.language = 'java' then '' else ', ' end || '","fields":[' || fields || ']}}', '') || '}}' as render
      from ops left join field_rows using (repo_id, http_method, http_path, p, language))"""
RENDER = RENDER.replace("{{\"callTemplate", "{\"callTemplate").replace("[{{\"name", "[{\"name").replace("}},{{\"name", "},{\"name").replace("string\"}}]", "string\"}]").replace("\"body\":{{", "\"body\":{").replace("']}}'", "']}'").replace("'}}' as render", "'}' as render")


@query("render_schema", f"with {FIELDS}, {RENDER} select repo_id, http_method, http_path, render from renders")
def render_schema(spark, sf):
    rows, nodes = prepared(spark, sf)
    return render.render_schemas(rows, nodes).select(*KEY, "render")


def metadata_of(languages):
    return languages.select("repo_id", "language", F.concat(F.lit("pkg"), "repo_id").alias("package_name"), F.lit("1.0").alias("sdk_version"),
                            F.when(F.col("repo_id") % 4 == 0, "").otherwise(F.concat(F.lit("c"), "repo_id")).alias("origin_commit"),
                            F.concat(F.lit("vendor/"), "language").alias("generator_name"))


@query("manifest_rows", f"""with {FIELDS}, {RENDER} select repo_id, http_method || ' ' || http_path as example_key, language, 'pkg' || repo_id as package_name,
    case when repo_id % 4 = 0 then 'unknown' else 'c' || repo_id end as spec_commit, coalesce(request_example, 'null') as request_body,
    coalesce(response_example, 'null') as response_body, case when is_streaming then true end as streaming, render from renders""")
def manifest_rows(spark, sf):
    rows, nodes = prepared(spark, sf)
    found = manifest.manifest_rows(match.examples(render.render_schemas(rows, nodes)), metadata_of(corpus.contract_languages(spark, sf)))
    return found.select("repo_id", "example_key", "language", "package_name", "spec_commit", "request_body", "response_body", "streaming", "render")


RULES = """case language when 'python' then '{"stringLiteral":"\\"{{value}}\\"","numberLiteral":"{{value}}","trueLiteral":"True","falseLiteral":"False","nullLiteral":"None","listLiteral":"[{{items}}]","listSeparator":", "}'
    when 'java' then '{"stringLiteral":"\\"{{value}}\\"","numberLiteral":"{{value}}","trueLiteral":"true","falseLiteral":"false","nullLiteral":"null","listLiteral":"Arrays.asList({{items}})","listSeparator":", "}'
    else '{"stringLiteral":"\\"{{value}}\\"","numberLiteral":"{{value}}","trueLiteral":"true","falseLiteral":"false","nullLiteral":"null","listLiteral":"[{{items}}]","listSeparator":", "}' end"""
DOCUMENT = f"""'{{"metadata":{{"language":"' || language || '","packageName":"pkg' || repo_id || '","sdkVersion":"1.0","specCommit":"' || case when repo_id % 4 = 0 then 'unknown' else 'c' || repo_id end
      || '","generatorName":"vendor/' || language || '"}},"renderRules":' || {RULES} || ',"examples":{{' || string_agg('"' || http_method || ' ' || http_path || '":{{"httpMethod":"' || http_method
      || '","httpPath":"' || http_path || '","request":{{"body":' || coalesce(request_example, 'null') || '}},"response":{{"body":' || coalesce(response_example, 'null')
      || case when is_streaming then ',"streaming":true' else '' end || '}},"render":' || render || '}}', ',' order by p) || '}}}}'"""


@query("manifest_json", f"with {FIELDS}, {RENDER} select repo_id, language, {DOCUMENT} as document from renders group by repo_id, language")
def manifest_json(spark, sf):
    rows, nodes = prepared(spark, sf)
    found = manifest.manifest_rows(match.examples(render.render_schemas(rows, nodes)), metadata_of(corpus.contract_languages(spark, sf)))
    return manifest.manifest_documents(found, render.render_rules(spark))


@query("body_merge", """select event_id, '{"k":' || cast(json_extract(props, '$.k') as varchar) || ',"keep":{"a":1,"b":' || case when event_id % 3 = 0 then '[9]' else '2' end
      || '},"list":' || case when event_id % 5 = 0 then '[3]' else '[1,2]' end || case when event_id % 3 = 0 then ',"new":{"z":"' || event_type || '"}' else '' end || '}' as body from events""")
def body_merge(spark, sf):
    events = corpus.table(spark, sf, "events")
    base = events.select("event_id", F.lit('{"k": {"deep": [1, {"x": 2}]}, "keep": {"a": 1, "b": 2}, "list": [1, 2]}').alias("json"))
    extra = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "new": {"z": "'), "event_type", F.lit('"}, "keep": {"b": [9]}'))).otherwise("")
    shorter = F.when(F.col("event_id") % 5 == 0, ', "list": [3]').otherwise("")
    over = events.select("event_id", F.concat(F.regexp_replace("props", r"\}\s*$", ""), extra, shorter, F.lit("}")).alias("json"))
    return values.merge(base, over, ["event_id"]).withColumnRenamed("json", "body")


def user_bodies(spark, sf, rows):
    """One body per endpoint, values from the part's size."""
    part = F.regexp_extract("http_path", r"/parts/(\d+)/", 1).cast("bigint")
    sizes = corpus.table(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("size"))
    tag = '{"next": {"any": null}, "label": "l", "other": 1}'
    body = F.when(F.col("p") % 6 == 1, corpus.text('{"role": "sys-tem", "name": "n\\"<s>", "tags": [' + tag + '], "unknown": 1}', s=F.col("size"))).when(
        F.col("p") % 6 == 2, corpus.text('{"size": <s>, "owner": ' + tag + ', "extra": {"deep": true}}', s=F.col("size"))).when(
        F.col("p") % 6 == 3, "[" + tag + ", null]").when(F.col("p") % 6 == 4, '{"audit_note": false}').when(
        F.col("p") % 6 == 5, corpus.text('"s<s>"', s=F.col("size"))).otherwise('{"page_size": 1.5}')
    return (rows.select("repo_id", "path_ord", "method_ord", part.alias("p")).join(sizes, "p")
            .select("repo_id", "path_ord", "method_ord", F.col("p").alias("call_id"), body.alias("body"),
                    F.create_map(F.lit("tagId"), F.lit('"user"'), F.lit("itemID"), F.concat(F.lit('"i'), "p", F.lit('"'))).alias("path_values")))


RENDERED = """rendered as (select ops.*, case language when 'python' then 'None' else 'null' end as nul,
      case language when 'python' then '{"next": {"any": None}, "label": "l", "other": 1}' when 'java' then 'Tag.builder().label("l").next({"any": null}).build()'
        else '{ "label": "l", "next": {"any": null} }' end as tag from ops),
    bodies as (select *, case when p % 6 = 0 then case language when 'python' then 'limit=1.5' when 'java' then '.pageSize(1.5)' else '"page_size": 1.5' end
      when p % 6 = 1 then case language when 'python' then 'name_="n\\"' || size || '", role="sys-tem", tags=[' || tag || ']'
        when 'java' then '.name("n\\"' || size || '").role(Role.SYS_TEM).tags(Arrays.asList(' || tag || '))' else '"name": "n\\"' || size || '", "role": Role.SysTem, "tags": [' || tag || ']' end
      when p % 6 = 2 then case language when 'python' then 'size=' || size || ', size=' || size || ', owner=' || tag || ', extra={"deep": True}'
        when 'java' then '.size(' || size || ').size(' || size || ').owner(' || tag || ').extra({"deep": true})'
        else '"size": ' || size || ', "size": ' || size || ', "owner": ' || tag || ', "extra": {"deep": true}' end
      when p % 6 = 3 then case language when 'java' then 'Arrays.asList(' || tag || ', null)' else '[' || tag || ', ' || nul || ']' end
      when p % 6 = 4 then case language when 'python' then 'audit_note=False' when 'java' then '.auditNote(false)' else '"audit_note": false' end
      else '"s' || size || '"' end as body from rendered)"""


@query("render_call", f"""with {OPS}, {RENDERED} select repo_id, http_method, http_path, replace(replace(replace({CALL_TEMPLATE}, '{{{{tagId}}}}', '"user"'), '{{{{itemID}}}}', '"i' || p || '"'),
    '{{{{__body__}}}}', body) as call_text from bodies""")
def render_call(spark, sf):
    rows, nodes = shaped(spark, sf)
    fields = render.catalog(nodes)
    templates = render.with_call_template(rows, render.root_kinds(nodes))
    return calltext.render_calls(user_bodies(spark, sf, rows), templates, render.top_fields(rows, fields), fields).select(*KEY, "call_text")
