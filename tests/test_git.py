"""Histories of a repository made here."""

import subprocess

import pytest

from palimpsest.sources import git


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")
    env = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x", "GIT_AUTHOR_DATE": "2020-01-02T03:04:05+0530", "GIT_COMMITTER_DATE": "2020-01-02T03:04:05+0530", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(root)}
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env=env)
    run("init", "-q")
    (root / "dir").mkdir()
    (root / "dir/a b.txt").write_text("one\ntwo\nthree\nfour\nfive\n")
    (root / "é.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-q", "-m", "first\n\nmore")
    run("mv", "dir/a b.txt", "dir/c.txt")
    (root / "é.py").write_text("x = 1\ny = 2\n")
    (root / "new").write_bytes(b"\0\1\2\n")
    run("add", "-A")
    run("commit", "-q", "-m", "second")
    (root / "new").unlink()
    run("add", "-A")
    run("commit", "-q", "-m", "third")
    return str(root)


def test_history(spark, repository):
    log = git.commits(spark, repository)
    got = log.collect()
    assert [r["subject"] for r in got] == ["third", "second", "first"] and {r["offset"] for r in got} == {330} and {r["seconds"] for r in got} == {1577914445}
    assert got[0]["parents"] == [got[1]["commit"]] and got[2]["parents"] == []
    assert git.commits(spark, repository, "HEAD~1..HEAD").count() == 1 and git.commits(spark, repository, "HEAD", "--", "new").count() == 2
    files = git.entries(log, repository)
    assert sorted(r["path"] for r in files.filter(f"commit = '{got[1]['commit']}'").collect()) == ["dir/c.txt", "new", "é.py"]
    assert git.search(files, r"\.py$").count() == 3
    content = {r["object"]: bytes(r["content"]) for r in git.blobs(files, repository).collect()}
    assert {content[r["object"]] for r in files.collect()} == {b"one\ntwo\nthree\nfour\nfive\n", b"x = 1\n", b"x = 1\ny = 2\n", b"\0\1\2\n"}
    assert all(len(content[r["object"]]) == r["bytes"] for r in files.collect())
    pairs = spark.createDataFrame([(got[2]["commit"], got[1]["commit"]), (got[1]["commit"], got[0]["commit"])], "commit1 string, commit2 string")
    changes = {(r["status"], r["path1"], r["path2"]) for r in git.changes(pairs, repository).collect()}
    assert changes == {("R", "dir/a b.txt", "dir/c.txt"), ("M", "é.py", "é.py"), ("A", None, "new"), ("D", "new", None)}
    lines = git.blame(spark.createDataFrame([(got[0]["commit"], "é.py")], "commit string, path string"), repository).orderBy("line").collect()
    assert [(r["line"], r["since"], r["text"]) for r in lines] == [(1, got[2]["commit"], "x = 1"), (2, got[1]["commit"], "y = 2")]
    with pytest.raises(RuntimeError):
        git.commits(spark, repository, "nothing")


def test_command(repository, capsys):
    git.main([repository, "log", "HEAD~2"])
    assert capsys.readouterr().out.rstrip().endswith("\tA\tfirst")
    git.main([repository, "cat", "HEAD:é.py"])
    assert capsys.readouterr().out == "x = 1\ny = 2\n"
    git.main([repository, "diff", "HEAD~2", "HEAD"])
    assert "dir/a b.txt\tdir/c.txt" in capsys.readouterr().out
    git.main([repository, "tree", "HEAD"])
    assert "dir/c.txt" in capsys.readouterr().out
    git.main([repository, "blame", "HEAD", "dir/c.txt"])
    assert capsys.readouterr().out.count("\n") == 5


def test_subversion_texts(spark, tmp_path):
    (tmp_path / "log.xml").write_text('<?xml version="1.0"?><log><logentry revision="3"><author>x</author><date>2020-01-01T00:00:00Z</date><paths><path action="M">/a/b</path><path action="A" copyfrom-path="/o" copyfrom-rev="1">/n</path></paths><msg>text</msg></logentry><logentry revision="2"><author>y</author><date>d</date><msg/></logentry></log>')
    got = {tuple(r) for r in git.read_svn_log(spark, str(tmp_path / "log.xml")).select("revision", "author", "action", "copied_from", "path").collect()}
    assert got == {(3, "x", "M", None, "/a/b"), (3, "x", "A", "/o", "/n"), (2, "y", None, None, None)}
    (tmp_path / "list.xml").write_text('<lists><list path="."><entry kind="file"><name>a</name><size>5</size><commit revision="3"/></entry><entry kind="dir"><name>d</name><commit revision="2"/></entry></list></lists>')
    assert {tuple(r) for r in git.read_svn_listing(spark, str(tmp_path / "list.xml")).collect()} == {("file", "a", 5, 3), ("dir", "d", None, 2)}
