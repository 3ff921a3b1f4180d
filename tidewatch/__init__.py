"""tidewatch: network-log analytics and intrusion detection as Spark jobs."""
