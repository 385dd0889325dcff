"""Folders of the given tables, for tests (a module of its own: every test folder has a conftest)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_GATE = "/root/testdata/sf0.01"
