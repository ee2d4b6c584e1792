"""Operators that change data: mutations over versioned tables, time to live, billing."""
