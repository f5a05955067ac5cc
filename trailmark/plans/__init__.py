"""trailmark.plans"""
