"""trailmark.functions"""
