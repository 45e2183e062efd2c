"""Payloads of boards, feeds, mails, forums and files to typed rows."""
