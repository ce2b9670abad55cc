from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodegraph import sinks
from lodegraph.functions import java_refs, lexers, lines, names, python_refs
from lodegraph.operators import references
from lodegraph.sources.trees import RULES, list_files, source_files


def tree(root, **files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def parts(spark, root, language, engine=None):
    rows = references.components(source_files(spark, root, language), language, engine).orderBy("corpus_index").collect()
    return {r.qualified_name: set(r.uses) for r in rows}


def test_listing(tmp_path):
    tree(tmp_path, **{"a.js": "", "A.TSX": "", "x.d.ts": "", "node_modules/m.js": "", "dist/b.js": "", "_p/q.mjs": "", "c.txt": ""})
    assert list_files(str(tmp_path), RULES["javascript"]) == ["A.TSX", "_p/q.mjs", "a.js"]
    tree(tmp_path, **{"M.java": "", "module-info.java": "", "N.JAVA": "", "__pycache__/z.py": "", "__init__.py": "", "k/__init__.py": ""})
    assert list_files(str(tmp_path), RULES["java"]) == ["M.java"]
    assert list_files(str(tmp_path), RULES["python"]) == ["__init__.py", "k/__init__.py"]


def test_reading(spark, tmp_path):
    tree(tmp_path, **{"_a/__init__.py": "x = 1\n", "b.py": "caf\u00e9"})
    (tmp_path / "bad.py").write_bytes(b"a\xff\r\nb")
    rows = source_files(spark, str(tmp_path), "python").orderBy("corpus_index").collect()
    assert [r.rel_path for r in rows] == ["_a/__init__.py", "b.py", "bad.py"]
    assert rows[2].text == "a\ufffd\nb"
    assert source_files(spark, tree(tmp_path / "none", **{"x.txt": ""}), "python").count() == 0


def test_executors_without_the_tree(spark, tmp_path):
    """A folder that the reading side doesn't see is an error, not a tree of unreadable files."""
    import shutil

    found = source_files(spark, tree(tmp_path / "gone", **{"a.py": "x = 1\n"}), "python")
    assert found.count() == 1
    from lodegraph.sources.trees import _Chunk, _Reader

    shutil.rmtree(tmp_path / "gone")
    with pytest.raises(FileNotFoundError):
        list(_Reader({"root": str(tmp_path / "gone"), "language": "python"}).read(_Chunk(0, ["a.py"])))


def test_lines(spark):
    texts = ["", "a", "a\n", "a\nb\r\nc\rd", "x\x0by\x0cz\x1cq\x85r\u2028s\u2029t", "\n\n"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lines.split_lines(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [t.splitlines(keepends=True) for t in texts]


def test_names(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    for path, want in {"a.ts": "a", "x/y.test.tsx": "x.y.test", "utils/index.ts": "utils", "index.js": "index", "B.MJS": "B", "lib/Index.js": "lib.Index"}.items():
        assert one(names.js_qname(F.lit(path))) == want
    for path, want in {"a.py": "a", "u/h.py": "u.h", "u/__init__.py": "u", "__init__.py": ""}.items():
        assert one(names.python_qname(F.lit(path))) == want
    assert one(names.java_qname(F.lit("// c\npackage com.x ;\nclass A {}"), F.lit("d/Foo.java"))) == "com.x.Foo"
    assert one(names.java_qname(F.lit("\n" * 50 + "package p;"), F.lit("Foo.java"))) == "Foo"
    for folder, spec, want in [("a/b", "../c", "a/c"), ("", "./x", "x"), ("a", "../../x", "../x"), ("a", ".", "a"), ("a", "..", "")]:
        assert one(names.normal_path(F.lit(folder), F.lit(spec))) == want


def test_javascript(spark, tmp_path):
    root = tree(
        tmp_path,
        **{
            "index.js": "import x from './utils'\nimport React from 'react'\n", "utils/index.ts": "export * from '../b'; // from './c'\n", "b.js": "const c = require('./c')\nimport('./d')\n",
            "c.jsx": "class K extends d {}\nimport './c'\n", "d.tsx": "class Q implements b, c {}\nimport fs from 'fs'\n", "types.d.ts": "", "node_modules/n.js": "",
        },
    )
    assert parts(spark, root, "javascript") == {"index": {"utils"}, "utils": {"b"}, "b": {"c", "d"}, "c": {"d"}, "d": {"b", "c"}}


def test_js_tokens(spark):
    text = "let a = `t ${x}` + 'it\\'s' /* no */ // no\n!== 1.5e3n ? \u00e9x : $y;"
    got = spark.createDataFrame([(text,)], "t string").select(lines.js_tokens(F.col("t"))).first()[0]
    assert got == ["let", "a", "=", "`t ${x}`", "+", "'it\\'s'", "!", "=", "=", "1.5e3n", "?", "x", ":", "$y", ";"]


def test_python(spark, tmp_path):
    root = tree(
        tmp_path,
        **{
            "app.py": "import os\nimport helper\nfrom utils import tool\nimport models\n\ndef f(x: Optional[models.User], *a: helper, **k) -> 'str':\n    y: models = 1\n",
            "helper.py": "import app\nclass H(models.M, metaclass=app): pass\n", "models.py": "import models\n", "utils/__init__.py": "", "utils/tool.py": "from . import x\n", "bad.py": "def (:\n", "__init__.py": "import app\n",
        },
    )
    assert parts(spark, root, "python") == {"app": {"helper", "utils", "utils.tool", "models"}, "helper": {"app"}, "models": set(), "utils": set(), "utils.tool": set()}
    broken = tree(tmp_path / "t", **{"a.py": "import b\ndef f(x: c) -> b:\n  return (\n", "b.py": "", "c.py": ""})
    assert parts(spark, broken, "python") == {"b": set(), "c": set()}
    assert parts(spark, broken, "python", "treesitter")["a"] == {"b", "c"}


def test_python_names():
    assert python_refs.references("x: A[B, c.D] | E = 1") == ["A", "B", "c.D", "E"]
    assert python_refs.references("\ufeffimport a") is None
    assert python_refs.references("from a import *\nfrom .b import c") == ["a", "b", "b.c"]


JAVA = """package p;
import q.Other; import static q.Util.run; import r.*;
/** doc: class Nope {} */
@Ann(value = "x") public final class Foo<T extends Z> extends Base<Arg> implements IFoo, List<Elem> {
  private Map<Key, Val> m = new HashMap<>(); int n;
  Foo(Ctor c) {}
  Ret<Gone> go(Par<In> p, Other... o) throws Ex { Loc l = null; for (Each e : o) { Stat.call(); a.b.run(); } return new Made().x(); }
  class Inner { Deep d; }
}
"""


def test_java_names():
    s = java_refs.read(JAVA)
    assert (s.ok, s.package, s.kind, s.name) == (True, "p", "class", "Foo")
    assert s.imports == [("q.Other", False), ("q.Util.run", False), ("r", True)]
    assert {"Base", "Arg", "IFoo", "List", "Elem", "Map", "Key", "Val", "Ctor", "Ret", "Par", "In", "Other", "Loc", "Stat", "a.b", "Made", "Deep"} <= set(s.names)
    assert not {"Gone", "Nope", "Foo", "Ann", "Each"} & set(s.names)
    # What a loop runs over, what is caught and resources aren't declared; what stands in their bodies is.
    assert java_refs.read("class A { void f() { try (R r = new S()) { T t; } catch (final U | V e) { W w; } for (X x : y) { Z z; } } }").names == ["S", "T", "W", "Z"]
    assert java_refs.read("interface A<T> extends B, C<D> { E e(); }").names == ["B", "C"]
    assert java_refs.read("enum A implements B { X; C c; }").names == []
    assert not java_refs.read("class A {").ok and not java_refs.read("this is not java").ok and not java_refs.read("").ok
    assert java_refs.read("@interface A {}").kind == "annotation"
    assert {"B", "C", "D"} <= set(java_refs.tolerant("class A extends B { C<D> x; ").names)


def test_java(spark, tmp_path):
    root = tree(
        tmp_path,
        **{
            "p/A.java": "package p; import q.C; import r.*; class A extends B { C c; D d; Only o; A self; java.util.List l; }", "p/B.java": "package p; class B { A a; }", "q/C.java": "package q; class C {}",
            "r/D.java": "package r; class D {}", "s/Only.java": "package s; class Only {}", "s/C.java": "package s; class C {}", "bad/X.java": "class { {", "p/package-info.java": "package p;", "module-info.java": "module m {}",
        },
    )
    assert parts(spark, root, "java") == {"p.A": {"p.B", "q.C", "r.D", "s.Only"}, "p.B": {"p.A"}, "q.C": set(), "r.D": set(), "s.Only": set(), "s.C": set()}
    loose = parts(spark, root, "java", "treesitter")
    assert loose["p.A"] >= {"p.B", "q.C", "r.D", "s.Only"} and "X" in loose


def test_java_tokens():
    assert lexers.java_tokens('int x=a>>>2;/*c*/"s\\""+\'c\'') == ["int", "x", "=", "a", ">", ">", ">", "2", ";", '"s\\""', "+", "'c'"]
    assert lexers.java_tokens("a # b") == ["a"]


def test_python_tokens():
    assert lexers.python_tokens("x = (1,\n") == ["x", "=", "(", "1", ","]
    assert lexers.python_tokens("if x:\n    y\n  z\n")[:2] == ["if", "x"]


def test_own_engine_and_tokenizer(spark, monkeypatch):
    """A language of one's own, from files to components and tokens."""
    for name in ("ENGINES", "DEFAULTS", "TOKENIZERS"):
        monkeypatch.setattr(references, name, dict(getattr(references, name)))

    def read(text):
        return {"status": "ok", "package": None, "simple_name": None, "refs": text.split(), "imports": []}

    references.register_engine("Words", "split", references.Engine(lambda: F.regexp_replace("rel_path", "\\.w$", ""), read))
    references.register_tokenizer("words", str.split)
    assert references.get_engine("words") == ("words", "split") and "words" in references.languages()
    files = spark.createDataFrame([(0, "a.w", "/a.w", "b c", None), (1, "b.w", "/b.w", "b", None)], "corpus_index int, rel_path string, path string, text string, error string")
    found = references.components(files, "words")
    assert {r.qualified_name: r.uses for r in found.collect()} == {"a": ["b"], "b": []}
    assert [r[0] for r in found.orderBy("corpus_index").select(references.token_column("words", F.col("text"))).collect()] == [["b", "c"], ["b"]]
    said = found.orderBy("corpus_index").select(sinks.component_text(F.col("qualified_name"), F.col("uses"), F.when(F.col("corpus_index") == 0, 4))).collect()
    assert [r[0] for r in said] == ["a refers to 1, class 4", "b refers to 0"]


def test_engines():
    assert references.get_engine("JAVA") == ("java", "javalang")
    assert references.list_engines() == {"java": ["javalang", "treesitter"], "python": ["ast", "treesitter"], "javascript": ["regex"]}
    for bad in [("cobol", None), ("java", "ast")]:
        with pytest.raises(ValueError, match="is called"):
            references.get_engine(*bad)
    assert references.tokens("unknown") is lexers.java_tokens
