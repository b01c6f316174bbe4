"""Plans: engine detection, the scan facade, registered queries."""
