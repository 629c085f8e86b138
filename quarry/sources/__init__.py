"""Foreign data: servers, foreign tables and readers whose predicates and columns reach the scan."""
