"""Constants that several test modules share (``conftest`` is a name each test folder has)."""

SF_SMALL = "/root/testdata/sf0.001"
