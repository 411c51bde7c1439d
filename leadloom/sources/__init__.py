"""Readers and writers: landed API payloads, directories, job boards, events, lead files."""
