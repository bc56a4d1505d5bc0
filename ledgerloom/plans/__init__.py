"""Plan fragments shared by the questions: snapshots, totals, running totals, ranks."""
