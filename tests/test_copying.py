from lectern.operators import copying, people


def test_strings_of_an_open_text():
    assert copying.strings('{"a": "x\\n", "b": [{"c": "y"}, "z"], "d": "op\\u00') == [("a", "x\n", True), ("c", "y", True), ("b", "z", True), ("d", "op", False)]
    assert copying.strings(None) == []


def test_copies():
    source = "## Rivers\nThe river rose in  spring. The river fell."
    assert copying.allowed(source, "The river rose") == 14
    assert copying.allowed(source, "river fell. In autumn") == 11
    assert copying.allowed(source, "THE RIVER", any_case=True) == 9
    assert copying.allowed("abc " * 3, "abc " * 200) < 200  # a loop of copies ends


def test_constraint_fails_open():
    assert copying.constraint("a river rose", lambda _: [" fell", " rose"], "a river", "caption") == " rose"
    assert copying.constraint("a river rose", lambda _: [" fell"], "a river", "caption") is None


def test_numbers_beside_names():
    raw = "## T\nJane Doe1, Max Roe1,2\n1 University of Alder; 2 Institute of Birch\n## Abstract\nx"
    assert people.by_numbers(["Doe", "Roe"], raw) == [["University of Alder"], ["University of Alder", "Institute of Birch"]]
    assert people.by_numbers(["Doe", "Lima"], raw) is None and people.by_numbers(["Doe", "Roe"], None) is None
