"""Word lists, capability lists and hook names that results depend on."""

LEVELS = ["unauthenticated", "subscriber", "contributor", "author", "editor", "admin", "superadmin"]
UNAUTHENTICATED, SUBSCRIBER, CONTRIBUTOR, AUTHOR, EDITOR, ADMIN, SUPERADMIN = range(7)
TYPES = ["rest", "ajax", "admin", "shortcode", "widget", "block", "hook_input", "direct"]

# WordPress core capabilities by level.
CORE_SUPERADMIN = ["manage_network", "manage_sites", "manage_network_users", "manage_network_plugins", "manage_network_themes", "manage_network_options", "setup_network", "upgrade_network", "create_sites", "delete_sites", "upload_plugins", "upload_themes"]
CORE_ADMIN = [
    "manage_options", "activate_plugins", "deactivate_plugins", "delete_plugins", "edit_plugins", "install_plugins", "update_plugins", "edit_themes", "install_themes", "update_themes", "switch_themes", "delete_themes", "edit_theme_options", "unfiltered_html", "unfiltered_upload", "import", "export",
    "list_users", "edit_users", "create_users", "delete_users", "promote_users", "remove_users", "update_core", "administrator", "customize", "edit_dashboard", "delete_site", "edit_files", "add_users", "edit_comment", "view_site_health_checks", "install_languages", "update_languages", "resume_plugins", "resume_themes",
    "manage_privacy_options", "erase_others_personal_data", "export_others_personal_data", "edit_user", "delete_user",
]
CORE_EDITOR = [
    "edit_others_posts", "edit_others_pages", "edit_published_posts", "edit_published_pages", "delete_others_posts", "delete_others_pages", "delete_published_posts", "delete_published_pages", "delete_private_posts", "delete_private_pages", "edit_private_posts", "edit_private_pages", "read_private_posts", "read_private_pages", "publish_pages",
    "moderate_comments", "manage_categories", "manage_links", "edit_categories", "delete_categories", "assign_categories", "edit_page", "delete_page", "publish_page", "edit_term", "delete_term", "assign_term",
]
CORE_AUTHOR = ["publish_posts", "upload_files", "edit_published_posts", "delete_published_posts", "publish_post"]
CORE_CONTRIBUTOR = ["edit_posts", "delete_posts", "edit_post", "delete_post"]
CORE_SUBSCRIBER = ["read", "exist", "level_0", "read_post", "read_page"]

# What the guard map (third capability map) lacks of the lists above, and has beyond them.
GUARD_MISSING = ["create_sites", "delete_sites", "deactivate_plugins", "unfiltered_upload", "delete_site", "add_users", "edit_comment", "view_site_health_checks", "install_languages", "update_languages", "resume_plugins", "resume_themes", "erase_others_personal_data", "export_others_personal_data", "delete_private_posts", "delete_private_pages", "edit_private_posts", "edit_private_pages", "read_private_posts", "read_private_pages", "edit_categories", "delete_categories", "assign_categories", "level_0"]
GUARD_EXTRA = {"edit_pages": EDITOR}

# Default configuration.
VENDOR_DIRS = ["vendor", "node_modules", ".git", "freemius", "action-scheduler", "redux-core", "redux-framework", "cmb2", "starter-content", "starter-templates"]
AJAX_ADMIN_PREFIXES = ["admin_", "manage_"]
AJAX_ADMIN_KEYWORDS = ["_admin_", "_admin", "_settings_save", "_save_settings", "_update_settings", "_options_save", "_save_options", "_reset_settings", "_reset_options", "_import_settings", "_export_settings"]
USER_FACING = [
    "form", "submit", "entry", "cart", "checkout", "order", "product", "shop", "store", "payment", "shipping", "profile", "account", "comment", "reply", "message", "contact", "post", "subscribe", "newsletter", "register", "login", "password", "bookmark", "favorite", "wishlist", "follow", "rating", "vote", "like", "share",
    "search", "filter", "sort", "load_more", "loadmore", "quick_view", "quickview", "preview", "popup", "modal", "slider", "booking", "appointment", "reservation", "calendar", "event",
]
REST_PUBLIC = ["/public/", "/embed/", "/widget/", "/oembed"]
REST_USER = ["/user/", "/me/", "/me", "/profile/", "/account/"]
REST_ADMIN = ["/admin/", "/admin-", "-admin/", "/settings", "/options", "/config", "/manage", "/dashboard"]

# Name heuristics.
ACTION_EXTRA = ["_search", "_list", "_log", "_query", "_panel", "_page", "_view", "_insight", "_statistic", "_report", "_check", "_hide", "_enable", "_disable", "_toggle"]
ACTION_LIKELY_ADMIN = [
    "save_", "_save", "update_", "_update", "edit_", "_edit", "delete_", "_delete", "remove_", "_remove", "create_", "_create", "new_", "_new", "add_", "install_", "_install", "uninstall", "activate", "deactivate", "upgrade", "downgrade", "migrate", "reset_", "_reset", "clear_", "_clear", "purge_", "_purge", "flush_", "_flush",
    "dismiss", "notice", "review", "feedback", "survey", "promo", "banner", "notification", "widget", "metabox", "dashboard", "screen_options", "config", "setting", "option", "preference", "setup", "wizard", "onboard", "import", "export", "backup", "restore", "sync", "generate", "regenerate", "build", "rebuild", "scan", "audit", "log", "debug",
    "license", "api_key", "apikey", "token", "connect", "disconnect", "authorize", "authenticate",
]
ROUTE_LIKELY_ADMIN = [
    "bulk", "batch", "/create", "/delete", "/update", "/save", "/edit", "/remove", "/clear", "/flush", "/reset", "/rebuild", "/regenerate", "/scan", "/audit", "/logs", "/debug", "/test", "sync", "/connect", "/disconnect", "/authorize", "/tokens", "/credentials", "/modules", "/plugins", "/themes", "/tools", "/utilities", "/send", "/publish", "/draft", "/trash", "/restore",
]
ROUTE_USER_FACING = [
    "/form", "/submit", "/post", "/comment", "/reply", "/message", "/contact", "/subscription", "/newsletter", "/register", "/login", "/auth", "/password", "/bookmark", "/favorite", "/wishlist", "/rating", "/vote", "/like", "/share", "/search", "/filter", "/cart", "/checkout", "/order", "/payment", "/shipping", "/address",
]
# What the names of unknown capabilities say: beginnings, endings and parts of admins' ones, then of editors'.
CAP_ADMIN_STARTS = ["manage_", "install_", "activate_", "update_", "delete_", "unfiltered_", "customize_", "setup_", "upgrade_"]
CAP_ADMIN_ENDS = ["_plugins", "_themes", "_users", "_shop"]
CAP_ADMIN_PARTS = ["shop_", "woocommerce", "backwpup", "backup", "restore", "updraft", "migrate", "duplicator"]
CAP_ADMIN_NAMES = ["edit_theme_options"]
CAP_EDITOR_STARTS = ["moderate_"]
CAP_EDITOR_PARTS = ["_others_", "_private_"]
# Calls, variables and array keys by which code says whom it lets in, and what it reads.
CAP_KEYS = ["capability", "cap"]
CAP_HOLDERS = ["$user", "$current_user", "$role", "$roleObject", "$this->user"]
ADMIN_CALLS = ["is_super_admin", "can_manage", "canManage", "is_admin_user", "isAdminUser"]
ADMIN_STATIC_CALLS = ["is_admin", "isAdmin", "is_Admin", "isadmin", "has_admin_capability", "check_admin", "checkAdmin", "isAdministrator"]
ADMIN_CALL_ENDS = ["check_permission", "check_permissions", "check_admin_permission", "check_admin_permissions", "checkpermission", "checkpermissions"]
ADMIN_NAME_PARTS = ["verify_capability", "verify_admin_capability", "verifyAdminCapability"]
LOGIN_CALLS = ["is_user_logged_in", "auth_redirect"]
USER_CALLS = ["get_current_user_id", "wp_get_current_user"]
NONCE_CALLS = ["wp_verify_nonce", "check_ajax_referer", "check_admin_referer"]
REQUEST_VARS = ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES"]
REQUEST_CALLS = ["filter_input", "get_query_var"]
PERMISSION_NAMES = ["can_", "_can_", "has_permission", "check_permission", "verify_permission", "permission_check", "permissions_check", "has_cap", "check_cap", "verify_cap", "is_allowed", "can_access", "check_access", "user_can", "require_cap"]
PERMISSION_ENDS = ["_permission", "_permissions", "_capability", "_capabilities"]

# Hooks, verbs, operations.
INPUT_HOOKS = ["init", "admin_init", "wp", "wp_loaded", "template_redirect", "send_headers", "parse_request", "plugins_loaded", "setup_theme", "after_setup_theme"]
CORE_HOOKS = [
    "plugins_loaded", "muplugins_loaded", "init", "wp_loaded", "wp", "admin_init", "admin_menu", "admin_bar_menu", "rest_api_init", "parse_request", "template_redirect", "template_include", "wp_head", "wp_footer", "admin_head", "admin_footer", "wp_enqueue_scripts", "admin_enqueue_scripts", "widgets_init", "after_setup_theme", "shutdown", "wp_ajax_",
    "woocommerce_init", "woocommerce_loaded", "elementor/widgets/register", "elementor/init", "acf/init", "acf/include_field_types",
]
TEMPLATE_DIRS = ["templates", "views", "partials", "tpl", "modules", "widgets", "blocks", "extensions"]
REST_VERBS = {"READABLE": "GET", "READ": "GET", "CREATABLE": "POST", "EDITABLE": "POST,PUT,PATCH", "DELETABLE": "DELETE", "ALLMETHODS": "GET,POST,PUT,PATCH,DELETE"}
# (rest base suffix, method, level, callback)
POST_TYPE_OPS = [("", "GET", 0, "get_items"), ("/{id}", "GET", 0, "get_item"), ("", "POST", 2, "create_item"), ("/{id}", "PUT,PATCH", 2, "update_item"), ("/{id}", "DELETE", 2, "delete_item")]
TAXONOMY_OPS = [("", "GET", 0, "get_items"), ("", "POST", 4, "create_item")]
# (hook prefix, type of route, level, whether the name heuristics apply, whether the body raises the level); longer prefixes win.
AJAX_HOOKS = [
    ("wp_ajax_nopriv_", "wp-admin/admin-ajax.php?action=", 0, False, "raise"),
    ("wp_ajax_", "wp-admin/admin-ajax.php?action=", 1, True, "raise"),
    ("admin_post_nopriv_", "wp-admin/admin-post.php?action=", 0, False, ""),
    ("admin_post_", "wp-admin/admin-post.php?action=", 5, False, "lower"),
    ("admin_action_nopriv_", "wp-admin/admin-ajax.php?action=", 0, False, ""),
    ("admin_action_", "wp-admin/admin-ajax.php?action=", 5, False, "lower"),
    ("wc_ajax_nopriv_", "?wc-ajax=", 0, False, ""),
    ("wc_ajax_", "?wc-ajax=", 1, True, "raise"),
    ("woocommerce_api_", "?wc-api=", 0, False, ""),
]
# Filters of the heartbeat, each an endpoint: (hook, level).
HEARTBEAT = [("heartbeat_received", 1), ("heartbeat_nopriv_received", 0), ("heartbeat_send", 1), ("heartbeat_nopriv_send", 0)]
# Callbacks that say nothing, for the dedup fold.
GENERIC_CALLBACKS = ["inline", "unknown", "closure", "anonymous", "anonymous_function"]
# Labels of install counts: at least n.
INSTALL_BUCKETS = [(10_000_000, "10+ million"), (5_000_000, "5+ million"), (1_000_000, "1+ million"), (500_000, "500,000+"), (100_000, "100,000+"), (50_000, "50,000+"), (30_000, "30,000+"), (20_000, "20,000+"), (10_000, "10,000+"), (1_000, "1,000+"), (100, "100+"), (10, "10+")]
RESERVED_SLUGS = ["browse", "developers", "featured", "popular", "beta"]
