"""Column-name helpers and the fixed vocabulary of the sales-pipeline model.

Source column names contain spaces, dots, slashes and parentheses
(``Potential No.``, ``State/UT``), so every reference goes through :func:`c`,
which back-quotes the name; an unquoted dotted name would be read as a
nested-field access.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q(name: str) -> str:
    """Back-quoted identifier usable in ``F.col`` and SQL text."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Column reference that is safe for names with dots and spaces."""
    return F.col(q(name))


def has(df: DataFrame, name: str) -> bool:
    """Plan-time presence check (reads the schema only, runs no job)."""
    return name in df.columns


def present(df: DataFrame, names) -> list[str]:
    """The wanted names that exist in ``df``, in the wanted order."""
    cols = set(df.columns)
    return [n for n in names if n in cols]


KEY = "Potential No."
DSR_TYPE = "DSR Type"
FLAG = "Flag"

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference's values for results to match;
# they are stated here as plain text, in their natural order.
# ---------------------------------------------------------------------------

# Stage relabelling applied to Stage / Original Stage / New Stage.
STAGE_MAPPING = {
    "2 Final Quote": "80 - Final Quote",
    "3 Negotiation/Review": "75 - Negotiation/Review",
    "4 Id. Decision Makers": "40 - Needs & problems understanding",
    "5 Value Proposition": "60 - Value Proposition",
    "6 Needs Analysis": "35 - Needs Analysis",
    "7 First Quote": "60 - Value Proposition",
    "8 Qualification": "20 - Qualification",
    "9 Prospecting": "10 - Prospecting",
    "Closed Customer not interested": "0 - Closed",
    "Closed Lost": "0 - Closed",
    "Closed Lost to Competition": "0 - Closed",
    "Closed Model Changed": "0 - Closed",
    "Closed Won": "100 - Billed",
    "Needs Analysis": "35 - Needs Analysis",
    "Perception Analysis": "35 - Needs Analysis",
    "0 - Closed - Customer not interested": "0 - Closed",
    "0 - Closed - customer placed order in another company name": "0 - Closed",
    "0 - Closed - Lost to Competition": "0 - Closed",
    "0 - Closed - Model Changed": "0 - Closed",
    "0 - Closed - our solution not suitable for customer": "0 - Closed",
    "0 - Closed - Product dropped from Portfolio": "0 - Closed",
    "0 - Closed - Project dropped": "0 - Closed",
    "0 - Closed -Project drop/too old /non core product/not very competitive. So potential being closed.": "0 - Closed",
    "100 - Closed Won-Full payment completed": "100 - Billed",
}

# Category relabelling.
CATEGORY_MAPPING = {
    "1. Hot": "Hot",
    "2. Followup": "Followup",
    "3. Cold": "Cold",
    "4. Yet to Contact": "Yet to Contact",
    "5. NR-No Response/Reply": "NR-No Response/Reply",
}

# Stage that means "closed / dropped".
CLOSED_STAGE = "0 - Closed"

# Stages removed from the movement grid after all counts.
GRID_EXCLUDED_STAGES = [
    "100 - Billed",
    "90 - On Hold",
    "20 - Contact in future No plan at present - Closed",
    "50 - Considering for Used Machine",
    "80 - Cancelled",
]

# Grid cell alerts: Dropped >= 1 on these stages is "pink", on the red stage "red".
ALERT_PINK_STAGES = [
    "80 - Final Quote",
    "85 - Order confirmed-Awaiting for PO",
    "90 - Purchase order recd.",
]
ALERT_RED_STAGE = "95 - Closed Won-Advance received"

# Number of grid rows shown.
GRID_MAX_ROWS = 20

# Cleaning floor: rows created or modified before this instant are dropped.
DEFAULT_MIN_DATE = "2021-01-01"

# pandas read_csv default null tokens.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Potentials: source-side columns dropped, then renamed.
P_DROP = ["Record Id", "Record Id (Contact Name)", "Record Id (Company Name)"]
P_RENAME = {
    "Sales handled by": "Executive",
    "Created Time": "Created Date",
    "Modified Time": "Modified Date",
    "Company Name (Company Name)": "Company Name",
}
P_DATES = ["Created Date", "Modified Date", "Closing Date", "Enquiry Date",
           "Last Contact Date", "Next Followup Date"]

# Activities (DSR): dropped, renamed, parsed.
DSR_DROP = ["Record Id", "Record Id (Potential Details)", "Next Followup Date",
            "Sales Handled By (Potential Details)", "Record Id (Company Name)"]
DSR_RENAME = {
    "Sales Person Name": "Executive",
    "Next Followup Date (Potential Details)": "Next Followup Date",
    "Created Time": "Created Date",
}
DSR_DATES = ["Created Date", "Contacted Date", "Next Followup Date", "Closing Date"]
DSR_TYPE_VALUE = "DSR"

# Previous / current status columns.
STATUS_COLUMNS = [
    "Previous Status Stage", "PS Contacted On Date", "PS Follow-up On Date",
    "PS Closure Date", "Current Status Stage", "CS Contacted On Date",
    "CS Follow-up On Date", "CS Closure Date",
]
STATUS_DATE_COLUMNS = [c_ for c_ in STATUS_COLUMNS if c_.endswith("Date")]

# Columns of the status table (before Flag).
SRL_COLUMNS = [
    "Region", "Executive", "Potential No.", "Potential Code", "Potential Name",
    "Campaign Source", "Mobile", "Billing City", "State/UT", "Email",
    "Lead Source", "Company Name", "Enquiry Date", "Last Contact Date",
    "Next Followup Date", "Created Date", "Modified Date", "Closing Date", "Stage",
    "Previous Status Stage", "PS Contacted On Date", "PS Follow-up On Date",
    "PS Closure Date", "Current Status Stage", "CS Contacted On Date",
    "CS Follow-up On Date", "CS Closure Date",
]

# The 12 date columns of the status table (the "any date in range" filter).
SRL_DATE_COLUMNS = [
    "Enquiry Date", "Created Date", "Modified Date", "Closing Date",
    "Last Contact Date", "Next Followup Date", "PS Contacted On Date",
    "PS Follow-up On Date", "PS Closure Date", "CS Contacted On Date",
    "CS Follow-up On Date", "CS Closure Date",
]

# Drill-down detail columns read from the merged table, and those then hidden.
DRILL_COLUMNS = [
    "Potential No.", "Potential Code", "Potential Owner", "Executive", "Company Name",
    "Billing City", "Stage", "Created Date", "Last Contact Date", "Next Followup Date",
    "Enquiry Date", "Closing Date", "Category", "Full Name", "Mobile", "Email",
    "Report ID", "Description (Potential Details)", "Modified Date", "Region",
    "Campaign Source", "Lead Source",
]
DRILL_HIDDEN = ["Description (Potential Details)", "Modified Date", "Region",
                "Campaign Source", "Lead Source"]
DRILL_DATE_COLUMNS = ["Created Date", "Last Contact Date", "Next Followup Date",
                      "Enquiry Date", "Closing Date"]

# Potential details: columns read from main rows, and the display groups.
DETAIL_READ_COLUMNS = [
    "Potential No.", "Potential Code", "Potential Owner", "Billing City", "Executive",
    "Region", "Campaign Source", "Lead Source", "Stage", "Probability (%)", "Full Name",
    "Mobile", "Email", "Category", "Enquiry Date", "Created Date", "Modified Date",
    "Next Followup Date", "Closing Date", "Last Contact Date", "DSR Type",
]
DETAIL_GROUPS = [
    ("location", ["Region", "Potential Code", "Billing City"]),
    ("people", ["Executive", "Potential Owner"]),
    ("source", ["Campaign Source", "Lead Source"]),
    ("stage", ["Stage", "Probability (%)", "Category"]),
    ("contact", ["Full Name", "Mobile", "Email"]),
    ("dates", ["Enquiry Date", "Created Date", "Modified Date"]),
    ("next_dates", ["Next Followup Date", "Closing Date", "Last Contact Date"]),
]
DETAIL_DATE_COLUMNS = ["Enquiry Date", "Created Date", "Modified Date",
                       "Next Followup Date", "Closing Date", "Last Contact Date"]

# Stage history of activities.
HISTORY_READ_COLUMNS = ["Created Date", "Original Stage", "New Stage", "Closing Date",
                        "Description (Potential Details)", "Potential No.", "DSR Type"]
HISTORY_COLUMNS = ["Created Date", "Original Stage", "New Stage", "Closing Date",
                   "Description"]

# Grid metric columns, in display order.
GRID_METRICS = ["OB", "Added-New", "Added-Old", "Moved", "Dropped", "CB"]

# Report filter name and selection labels of the export header block.
EXPORT_FILTER_NAMES = ["Region", "Executive", "Potential Code", "Stage Filter",
                       "Criterion Date", "Report"]

# Column-width caps used by the exports.
WIDTH_CAP_REPORT = 50
