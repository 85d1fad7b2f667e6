import json

from sdkatlas.sources import artifacts, repo, trees


def test_tree_metadata_packages_and_locations(spark, tmp_path):
    layout = {
        1: {".gen/metadata.json": json.dumps({"generatorName": "v/python-and-java", "sdkVersion": "1", "originGitCommit": "c1"}), "pyproject.toml": '[x]\nname = "one"\nname = "two"\n',
            "src/_private/a.py": "", "src/.hidden/a.py": "", "src/zeta/a.py": "", "src/alpha/openapi/openapi.json": "{}", "openapi/openapi.json": "{}"},
        2: {"package.json": '{"name": ""}', "openapi/openapi.json": '{"paths": {}}'},
        3: {".gen/metadata.json": json.dumps({"generatorName": "v/ruby"}), "build.gradle": "group = 'g'\nartifactId = \"a\""},
        4: {"build.gradle": "group = 'g'"},
    }
    root = tmp_path / "corpus"
    for number, tree in layout.items():
        for path, content in tree.items():
            target = root / str(number) / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(content)
    files = trees.read_tree(spark, str(root)).cache()
    repos = files.select("repo_id").distinct()
    overrides = spark.createDataFrame([(2, "typescript"), (4, "java")], "repo_id bigint, language string")
    languages = repo.repo_languages(repos, repo.read_metadata(files), overrides).cache()
    assert {r.repo_id: (r.language, r.generator_name, r.origin_commit, r.status) for r in languages.collect()} == {
        1: ("python", "v/python-and-java", "c1", "ok"), 2: ("typescript", "typescript-sdk", "unknown", "ok"),
        3: (None, "v/ruby", None, "unsupported_generator"), 4: ("java", "java-sdk", "unknown", "ok")}
    names = repo.package_names(languages.filter("status = 'ok'"), files)
    assert {r.repo_id: r.package_name for r in names.collect()} == {1: "one", 2: "unknown", 4: "g"}
    places = repo.spec_locations(languages, files.select("repo_id", "path"))
    assert {r.repo_id: r.spec_path for r in places.collect()} == {1: "src/alpha/openapi/openapi.json", 2: "openapi/openapi.json", 3: None, 4: None}
    assert {r.repo_id: r.doc for r in trees.spec_documents(files, places).collect()} == {1: "{}", 2: '{"paths": {}}', 3: None, 4: None}


def test_changes_and_writes(spark, tmp_path):
    side = lambda rows: artifacts.with_digest(spark.createDataFrame(rows, "k string, payload string"))
    current, stored = side([("new", "1"), ("same", "1"), ("changed", "2"), ("other", "9")]), side([("same", "1"), ("changed", "1"), ("gone", "1")])
    listed = spark.createDataFrame([(k,) for k in ("new", "same", "changed", "gone")], "k string")
    assert {r.k: r.change for r in artifacts.changes(current, stored, ["k"], listed).collect()} == {
        "new": "inserted", "same": "unchanged", "changed": "updated", "gone": "deleted"}
    assert {r.k for r in artifacts.to_write(current, stored, ["k"], listed).collect()} == {"new", "changed"}
    documents = spark.createDataFrame([(1, "python", '{"a":1}'), (2, "java", '{"b":2}')], "repo_id bigint, language string, document string")
    artifacts.write_manifests(documents, str(tmp_path / "out"))
    assert {(r.language, r.value) for r in spark.read.text(str(tmp_path / "out")).collect()} == {("python", '{"a":1}'), ("java", '{"b":2}')}


def test_store(spark, tmp_path):
    from sdkatlas.sources import store

    place = str(tmp_path / "store")
    tree = lambda rows: spark.createDataFrame(rows, "repo_id bigint, path string, content string")
    now = lambda kinds=None: {(r.repo_id, r.path, r.kind, r.content) for r in store.read(spark, place, kinds).collect()}
    assert store.read(spark, place).count() == 0 and store.listing(spark, place).count() == 0
    first = [(1, "src/a.py", "x"), (1, "LICENSE", ""), (2, "src/a.py", "x"), (2, "b/C.java", "y")]
    assert store.put(tree(first), place) == 4 and store.put(tree(first), place) == 0 and store.versions(spark, place) == [0]
    assert now() == {(1, "src/a.py", "py", "x"), (1, "LICENSE", "none", ""), (2, "src/a.py", "py", "x"), (2, "b/C.java", "java", "y")}
    assert store.put(tree([(2, "src/a.py", "new"), (2, "b/C.java", "y"), (3, "d.ts", "é")]), place) == 2
    assert now() == {(1, "src/a.py", "py", "x"), (1, "LICENSE", "none", ""), (2, "src/a.py", "py", "new"), (2, "b/C.java", "java", "y"), (3, "d.ts", "ts", "é")}
    assert now(["py"]) == {(1, "src/a.py", "py", "x"), (2, "src/a.py", "py", "new")}
    assert {(r.repo_id, r.path, r.size, r.version) for r in store.listing(spark, place).collect()} == {
        (1, "src/a.py", 1, 0), (1, "LICENSE", 0, 0), (2, "src/a.py", 3, 1), (2, "b/C.java", 1, 0), (3, "d.ts", 2, 1)}
    tree([(9, "half.py", "z")]).selectExpr("*", "1L as size", "'d' as digest", "'py' as kind").write.partitionBy("kind").parquet(f"{place}/version=2")
    assert not [r for r in now() if r[0] == 9]  # a version that is not in the log is not there
    plan = store.listing(spark, place)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema: ")[1].splitlines()[0]


def test_trailing_text_is_no_document(spark):
    from pyspark.sql import functions as F
    from sdkatlas.operators import contract

    docs = ['{"a":1}', ' {"a": {"b": [1]}}\n', '{"a":1} trailing', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1,"a":2}', '[1]', '{"a":', '', '{}', '{"a":1}]']
    rows = spark.createDataFrame([(d,) for d in docs] + [(None,)], "doc string")
    good = [r[0] for r in rows.filter(contract.is_document(F.col("doc"))).collect()]
    assert good == [docs[0], docs[1], docs[5], "{}"]
