"""Row types at the boundaries."""

from __future__ import annotations

SEEN_JOB = """
job_key string, first_seen_at timestamp, last_seen_at timestamp, title string, company string,
location string, linkedin_url string, jobright_url string, external_jd_url string
"""
