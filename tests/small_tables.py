"""Where the smallest given tables are."""

SMALL = "/root/testdata/sf0.001"
