"""What is decided before a plan is built: requests, the filter language, strategy rules."""
