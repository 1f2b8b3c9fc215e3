"""Where nodes, edges, history and logs come from, and where snapshots go."""
