"""The fixed vocabularies as literals, so that a slip in one place does not pass unseen."""

from stagecraft import columns as C


def test_stage_mapping():
    closed = ["Closed Customer not interested", "Closed Lost", "Closed Lost to Competition", "Closed Model Changed"]
    assert {k: v for k, v in C.STAGE_MAPPING.items() if not k.startswith(("0 - ", "100 - "))} == {
        "2 Final Quote": "80 - Final Quote", "3 Negotiation/Review": "75 - Negotiation/Review",
        "4 Id. Decision Makers": "40 - Needs & problems understanding",
        "5 Value Proposition": "60 - Value Proposition", "6 Needs Analysis": "35 - Needs Analysis",
        "7 First Quote": "60 - Value Proposition", "8 Qualification": "20 - Qualification",
        "9 Prospecting": "10 - Prospecting", "Closed Won": "100 - Billed", "Needs Analysis": "35 - Needs Analysis",
        "Perception Analysis": "35 - Needs Analysis", **dict.fromkeys(closed, "0 - Closed")}
    assert {v for k, v in C.STAGE_MAPPING.items() if k.startswith("0 - ")} == {"0 - Closed"}
    assert C.STAGE_MAPPING["100 - Closed Won-Full payment completed"] == "100 - Billed"
    assert C.CLOSED_STAGE == "0 - Closed"


def test_category_mapping():
    assert C.CATEGORY_MAPPING == {"1. Hot": "Hot", "2. Followup": "Followup", "3. Cold": "Cold",
                                  "4. Yet to Contact": "Yet to Contact",
                                  "5. NR-No Response/Reply": "NR-No Response/Reply"}


def test_grid_metrics_and_filter_names():
    assert C.GRID_METRICS == ["OB", "Added-New", "Added-Old", "Moved", "Dropped", "CB"]
    assert C.EXPORT_FILTER_NAMES == ["Region", "Executive", "Potential Code", "Stage Filter", "Criterion Date", "Report"]
