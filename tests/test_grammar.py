import pytest

from orbweaver.plans.grammar import Grammar, Rule, normalized


def test_parse_skips_comments_blanks_and_carriage_returns():
    g = Grammar.parse("# rules\r\n3\r\n\r\nA\r\n# more\nA\tB\r\nC\tA\tB\n")
    assert g.rules == (Rule("A"), Rule("A", "B"), Rule("C", "A", "B"))
    assert (g.epsilon, g.unit, g.binary) == ([Rule("A")], [Rule("A", "B")], [Rule("C", "A", "B")])
    assert g.labels == ["A", "B", "C"] and g.nonterminals == {"A", "C"}
    assert Grammar.parse(g.to_text()).rules == g.rules


@pytest.mark.parametrize("text", ["", "x\nA\tB\n", "2\nA\tB\n", "1\nA\tB\nA\tC\n", "1\nA\tB\tC\tD\n"])
def test_parse_refuses(text):
    with pytest.raises(ValueError):
        Grammar.parse(text)


def test_of_and_repeats():
    assert Grammar.of("A ::= B C", "A ::=", "A ::= B C").rules == (Rule("A", "B", "C"), Rule("A"))
    for bad in ("A B", "A ::= B C D", "::= B"):
        with pytest.raises(ValueError):
            Grammar.of(bad)


def test_dataflow_faults():
    assert not Grammar.of("N ::= N e").dataflow_faults()
    assert Grammar.of("A ::= B").dataflow_faults()
    assert Grammar.of("A ::= A A").dataflow_faults()
    assert Grammar.of("A ::= A e", "e ::=").dataflow_faults()


def test_sliced_keeps_what_can_matter():
    g = Grammar.of("A ::= B c", "B ::= d", "X ::= A A")
    assert g.sliced(["A"]).rules == (Rule("A", "B", "c"), Rule("B", "d"))


def test_chains_are_found_where_steps_are_closed():
    assert Grammar.of("P ::= n", "P ::= P n").chain() == Grammar.of("P ::=", "P ::= P n").chain() == ("P", "n", True)
    assert Grammar.of("P ::= n", "P ::= n P").chain() == ("P", "n", False)
    two = Grammar.of("Q ::= P", "Q ::= Q P", "P ::= n", "P ::= P n")
    assert two.chain() == ("P", "n", True) and two.without("P").chain() == ("Q", "P", True) and two.without("P").without("Q").chain() is None
    for other in (("P ::= n", "P ::= P m"), ("P ::= n", "P ::= P n", "P ::= m"), ("P ::=", "P ::= P n", "n ::= P"), ("P ::= n", "P ::= P P"), ("P ::= P n",)):
        assert Grammar.of(*other).chain() is None


def test_normalized():
    rules = normalized("A", "b", "c", "d", "e")
    assert rules[0].rhs1 == "b" and rules[-1].rhs1 == "d" and rules[-1].rhs2 == "e" and len(rules) == 3
