"""Where the small test tables lie."""

DIR = "/root/testdata/sf0.001"
