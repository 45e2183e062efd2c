"""postmill: record-processing operators for postings, mails, pages and posts on PySpark."""
