"""A corpus of documents written here, read from files."""

from pyspark.sql import functions as F

from vetspark.sources.corpus import corpus_findings, read_documents, read_paths

GOOD = "---\nname: a-skill\ndescription: d\nversion: 1\ncategory: c\n---\nSee `docs/guide.md`, `docs/none.md` and `plain.md`.\n## Usage\n"


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")


def test_findings_of_a_corpus(spark, tmp_path):
    root = tmp_path / "a corpus+1"
    write(root, {"SKILL.md": GOOD, "docs/guide.md": "no front `docs/deep/ü x.md` `docs/guide.md` `gone/a.md` `gone/a.md`\n", "docs/deep/note 1.md": "x", "docs/empty.md": "", "docs/data.json": "{}", "docs/b.md": GOOD.replace("a-skill", "A Skill").replace("## Usage", "")})
    docs, files = read_documents(spark, str(root)), read_paths(spark, str(root))
    assert {r.path for r in docs.collect()} == {"SKILL.md", "docs/guide.md", "docs/deep/note 1.md", "docs/b.md"}
    assert {r.path for r in files.collect()} == {"SKILL.md", "docs/guide.md", "docs/deep/note 1.md", "docs/b.md", "docs/data.json"}
    assert docs.filter("path = 'SKILL.md'").first().text == GOOD
    got = {tuple(r) for r in corpus_findings(docs, files, conform=["SKILL.md", "docs/b.md"], scan=["SKILL.md", "docs/guide.md", "README.md"], headings=["## Usage"]).collect()}
    assert got == {
        ("SKILL.md", "dangling", "docs/none.md"), ("docs/guide.md", "dangling", "gone/a.md"), ("docs/b.md", "error", "name malformed"), ("docs/b.md", "error", "missing sections: ## Usage"),
        ("README.md", "warning", "README.md: not there, so its references were not looked at"),
    }
    every = corpus_findings(docs, files)
    assert {(r.path, r.kind) for r in every.collect()} == {("SKILL.md", "dangling"), ("docs/guide.md", "dangling"), ("docs/guide.md", "error"), ("docs/b.md", "dangling"), ("docs/b.md", "error"), ("docs/deep/note 1.md", "error")}
    plan = every._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan text") == 1  # one look at every text


def test_contents_of_other_files_stay_unread(spark, tmp_path):
    write(tmp_path, {"x/a.bin": "z" * 1000})
    scan = read_paths(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("ReadSchema")[1] and read_paths(spark, str(tmp_path)).first().path == "x/a.bin"


def test_an_empty_corpus(spark, tmp_path):
    docs, files = read_documents(spark, str(tmp_path)), read_paths(spark, str(tmp_path))
    assert docs.count() == 0 and corpus_findings(docs, files).count() == 0
    assert [r.kind for r in corpus_findings(docs, files, scan=["a.md"]).collect()] == ["warning"]
    one = spark.createDataFrame([("p.md", None)], "path string, text string")
    assert [tuple(r) for r in corpus_findings(one, files).select("path", "kind", F.col("finding")).collect()] == [("p.md", "error", "no frontmatter")]
