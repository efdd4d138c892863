"""Table-to-table operators; every one takes the column names it works on."""
