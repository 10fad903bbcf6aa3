import pytest

from textlake.operators import syntax as S

T = S.read_tree


@pytest.mark.parametrize(
    ("tree", "cnf"),
    [
        ("(X (Y u))", "(X+Y u)"),
        ("(X (Y u) (Z v))", "(X (Y u) (Z v))"),
        ("(X (P a) (Q (R b)) (S c) (T (U d) (V e)))", "(X (P_Q_S (P_Q (P a) (Q+R b)) (S c)) (T (U d) (V e)))"),
        ("(X (P a) (Q (R (S b) (T c) (U (V d)))))", "(X (P a) (Q+R (S_T (S b) (T c)) (U+V d)))"),
    ],
)
def test_normal_form(tree, cnf):
    assert S.write_tree(S.to_cnf(T(tree))) == cnf
    assert S.write_tree(S.from_cnf(T(cnf))) == tree


def test_improper_trees():
    assert S.to_cnf(None) is None and S.from_cnf(None) is None
    for tree in (("X", ("Y", "a"), "word"), ("X", ("Y", "a"), ('"Z"', "b"), ("U", "c"))):
        with pytest.raises(S.Improper):
            S.to_cnf(tree)
        with pytest.raises(S.Improper):
            S.from_cnf(tree)
    for text in ("(A (B c)", "(A b))"):
        with pytest.raises(S.Improper):
            T(text)


def test_cleaning_and_nodes():
    tree = S.cleaned(T("( (S (NP-SBJ (-NONE- *) ) (VP-X (VB go) (NP (-NONE- t)))) )"))
    assert S.write_tree(tree) == "(S (VP (VB go)))"
    rows = S.node_rows(T("(S (NP (A x) (B y)) (V z))"))
    assert [(r["label"], r["parent_id"], r["lo"], r["hi"], r["word"]) for r in rows] == [("S", -1, 0, 3, None), ("NP", 0, 0, 2, None), ("A", 1, 0, 1, "x"), ("B", 1, 1, 2, "y"), ("V", 0, 2, 3, "z")]


def test_cky():
    trees = ["(TOP (S (N we) (VP (V see) (N them))))", "(TOP (S (N they) (VP (V go))))", "(TOP (S (N we) (VP (V go))))"]
    rules = S.grammar(S.to_cnf(T(t)) for t in trees)
    assert rules["N", "we"] == 0.5
    for t in trees:
        best = S.cky([w for w, _ in S.leaves(T(t))], rules, n_best=3)
        assert S.write_tree(best[0][1]) == t and best[0][0] >= best[-1][0]
    assert S.cky(["unknown"], rules) == []


def test_rendering():
    tree = T("(S (NP (D the) (N cat)) (V sits))")
    assert [line.rstrip() for line in S.render_tree(tree)] == ["      S", "   .------.", "   NP     :", " .---.    :", " D   N    V", " :   :    :", "the cat sits"]
    assert all(len(line) == len(S.render_tree(tree)[0]) for line in S.render_tree(tree))
    assert S.render_tags([("a", "DT"), ("cat", "N")]) == ["DT  N  ", " a cat "]
    assert S.render_deps([("root", 0, 2, "sits"), ("subj", 2, 1, "cat")])[0] == "cat sits"


def test_dependencies(spark):
    lines = spark.createDataFrame([("subj(sits-2, cat-1)",), ("root ( ROOT-0 , sits-2 )",), ("no dependency",)], "value string")
    got = {(r.rel, r.head_id, r["head"], r.tail_id, r["tail"]) for r in S.stanford_deps(lines).collect()}
    assert got == {("subj", 2, "sits", 1, "cat"), ("root", 0, "ROOT", 2, "sits")}
    rows = [("f", 0, "1\tCats\tcat\tNNS\t_\t_\t2\tSUB"), ("f", 1, "2\tsit\t_\tVB\t_\t_\t0\tROOT"), ("f", 2, ""), ("f", 3, "1\tGo\tgo\tVB\t_\t_\t0\tROOT")]
    deps = S.conll_deps(spark.createDataFrame(rows, "file string, line_no int, value string"))
    assert {(r.sent_id, r.tail_id, r.lemma, r.head_id) for r in deps.collect()} == {(0, 1, "cat", 2), (0, 2, None, 0), (1, 1, "go", 0)}
    assert sorted(r.line for r in S.conll_text(deps).collect()) == sorted(v for _, _, v in rows if v)
    assert S.deps_tree([("root", 0, 2, "sits"), ("subj", 2, 1, "cat")]) == "(root (subj cat) sits)"
