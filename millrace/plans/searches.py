"""The search and the clock that the registered queries use."""

from __future__ import annotations

from datetime import date

from millrace.operators import gates as G

TODAY = date(1998, 1, 1)
ACCOUNTING = G.Rules(
    "accounting-remote",
    titles=["accounts payable specialist", "accountant"],
    related_titles=["internal auditor", "cash management analyst"],
    title_excludes=["staff"],
    seniority_excludes=["senior", "management"],
    workplace_types=["remote", "hybrid"],
    excluded_content=["auditing", "security clearance"],
    keywords=["accounts payable", "CPA", "excel", "audits"],
    needs_sponsorship=True,
    employment_types=["full_time", "contract"],
    salary_min=30000,
    max_age_days=900,
)
