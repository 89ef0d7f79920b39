"""Report definitions and the import and refresh jobs."""
